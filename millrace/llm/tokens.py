"""Token-id output in bit-plane shuffled chunks.

Token ids are cut into blocks of ``BLOCK`` ids. A block of little-endian 32-bit ids is transposed into byte or
bit planes: plane i holds byte (or bit) i of every id, so the planes of high bytes are nearly constant and
compress to almost nothing. Each plane is compressed with zstandard on its own.

A chunk is one block as bytes: the magic ``MTP1``, a flag for bit planes, the number of ids, the number of
planes, the planes' compressed lengths, then the planes. A file holds the chunks of one range of documents; it
is a Parquet file with a row per chunk, so that Spark's writer commits it and a lost executor leaves no
half-written file. Its columns beside the chunk are the chunk index: ``shard``, ``chunk``, ``n_ids``, and for
every piece of a document in the chunk ``docs`` (number of the document in its shard, doc_id, offset of the piece in the
document, ids of the piece, ids of the document). The sums per shard give each shard's first id; they are the only thing that is gathered.

Documents are dealt by ranges of doc_id, so shards are in ascending doc_id order and no task holds more than a
range. Ids come from the ``tokenizers`` library. Text is encoded by word: the tokenizer's pre-tokenizer drops
white space and never joins across it, so the ids of a text are those of its words in order
(``encode_by_words`` checks this against whole texts in the tests). Within a batch each different word is
encoded once, and a bounded cache keeps words over batches.

Defined cases: a null text is an empty text and has the end id only; rows that repeat are written as often as they
come, in an order fixed by doc_id and text; a null doc_id comes first; an empty table gives no chunks and no rows.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import documents, whole

END_ID = 1
BLOCK = 1 << 16
MAGIC = b"MTP1"
#: Words that a worker keeps encoded; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Bytes of text that are encoded at a time, unless one text is longer.
BATCH_CHARS = 1_500_000

CHUNK_SCHEMA = (
    "shard int, chunk long, n_ids long, chunk_bytes binary, "
    "docs array<struct<number:long, doc_id:bigint, offset:long, ids:long, of:long>>"
)
PIECE = [(name, pa.int64()) for name in ("number", "doc_id", "offset", "ids", "of")]


def pack(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """One block of ids as a chunk."""
    import zstandard

    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits:  # 32 planes, most significant bit of each byte first
        planes = np.packbits(np.unpackbits(planes[:, :, None], axis=2).transpose(0, 2, 1).reshape(32, -1), axis=1)
    squeeze = zstandard.ZstdCompressor(level=level).compress
    body = [squeeze(plane.tobytes()) for plane in planes]
    return MAGIC + struct.pack(f"<BII{len(body)}I", bits, len(ids), len(body), *map(len, body)) + b"".join(body)


def unpack(chunk: bytes) -> np.ndarray:
    """The ids of a chunk."""
    import zstandard

    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    bits, n, planes = struct.unpack_from("<BII", chunk, 4)
    lengths, at = struct.unpack_from(f"<{planes}I", chunk, 13), 13 + 4 * planes
    expand, rows = zstandard.ZstdDecompressor().decompress, []
    for length in lengths:
        rows.append(np.frombuffer(expand(chunk[at : at + length]), np.uint8))
        at += length
    flat = np.stack(rows) if n else np.zeros((planes, 0), np.uint8)
    if bits:
        flat = np.packbits(np.unpackbits(flat, axis=1)[:, :n].reshape(4, 8, n).transpose(0, 2, 1), axis=2)[:, :, 0]
    return np.ascontiguousarray(flat.T).view("<u4").ravel()


class WordEncoder:
    """Encodes batches of texts; each different word goes through the tokenizer once while it is in the cache."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the shortcut for letters holds for tokenizers that lower their text and cut it between letters and signs
        self.lowers = all(self.tokenizer.encode(x, add_special_tokens=False).ids == self.tokenizer.encode(y, add_special_tokens=False).ids for x, y in (("Aa,B;", "aa , b ;"), ("it's (X)", "it 's ( x )")))
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.piece_end = None
        if self.lowers and suffix:
            self.piece_end = np.zeros(max(vocabulary.values()) + 1, bool)
            self.piece_end[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        # texts that hold the name of a special token keep it whole
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()

    @staticmethod
    def of(path: str) -> "WordEncoder":
        """The worker's encoder: tasks that follow each other in one Python worker share its words."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_word_encoders", {})
        if path not in kept:
            kept[path] = WordEncoder(path)
        return kept[path]

    def _forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids, self.length = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32), np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int32)

    def _codes(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the cache, which starts anew when it would hold more than ``CACHE_WORDS``."""
        if len(self.code) + len(words) > CACHE_WORDS:
            self._forget()
        code = self.code
        new = [w for w in words if w not in code]
        found = self._encode(new)
        if new:
            code.update(zip(new, range(len(code), len(code) + len(new)), strict=True))
            length = np.fromiter(map(len, found), np.int32, len(found))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(length, dtype=np.int32) - length])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.ids.dtype, int(length.sum()))])
            self.length = np.concatenate([self.length, length])
        return np.fromiter(map(code.__getitem__, words), np.int64, len(words))

    def _encode(self, new: list[bytes]) -> list[list[int]]:
        """Ids of each word. Words of letters are one piece each, so a text of many of them is cut after its piece ends."""
        found: list[list[int]] = [[]] * len(new)
        text = [w.decode() for w in new]
        plain = [i for i, w in enumerate(text) if w.isalpha()] if self.piece_end is not None else []
        other = set(range(len(new))).difference(plain) if plain else range(len(new))
        for i in range(0, len(plain), 2_000):
            part = plain[i : i + 2_000]
            ids = self.tokenizer.encode(" ".join([text[k] for k in part]), add_special_tokens=False).ids
            ends = np.flatnonzero(self.piece_end[ids]) + 1
            if len(ends) != len(part):  # some letter is none to the tokenizer
                other = [*other, *part]
                continue
            at = 0
            for k, end in zip(part, ends.tolist(), strict=True):
                found[k] = ids[at:end]
                at = end
        rest = list(other)
        for i in range(0, len(rest), 2_000):
            part = rest[i : i + 2_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([text[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = e.ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, with ``END_ID`` after each text, and the number of ids per text.

        ASCII letters are lowered and set apart from a sign that follows, as the tokenizer itself does; that leaves
        far fewer different words.
        """
        apart = texts
        if self.lowers:
            split = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-/:-@\[-`{-~])", r"\1 \2")
            apart = pc.if_else(pc.match_substring_regex(texts, self.special, ignore_case=True), texts, split) if self.special else split
        words = pc.ascii_split_whitespace(apart)
        of_text = pc.list_parent_indices(words).to_numpy()
        coded = pc.list_flatten(words).dictionary_encode()
        code = self._codes(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.length[code]
        per_text = np.bincount(of_text, weights=n, minlength=len(texts)).astype(np.int64) + 1
        total = int(n.sum())
        # each id's place in the cache: its word's first place, and how far the id is into the word
        source = np.arange(total, dtype=np.int32)
        source += np.repeat(self.first[code] - (np.cumsum(n, dtype=np.int32) - n), n)
        out = np.full(total + len(texts), END_ID, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(per_text) - 1] = False
        out[keep] = self.ids[source]
        pa.default_memory_pool().release_unused()
        return out, per_text


def encode_by_words(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of each text without the end id."""
    out, n = WordEncoder(path).encode(pa.array(texts, pa.string()))
    return [x[:-1].tolist() for x in np.split(out, np.cumsum(n)[:-1])]


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds about ``BATCH_CHARS`` bytes of text, or one row."""
    for batch in rows:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // BATCH_CHARS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _pieces(number: int, doc_id: pa.Array, counts: np.ndarray) -> pa.StructArray:
    """Whole documents as pieces, numbered from ``number``."""
    n = pa.array(counts, pa.int64())
    return pa.StructArray.from_arrays([pa.array(number + np.arange(len(counts))), doc_id, pa.array(np.zeros(len(counts), np.int64)), n, n], fields=[pa.field(*f) for f in PIECE])


def _at_blocks(pieces: pa.StructArray) -> tuple[pa.StructArray, np.ndarray]:
    """The pieces cut where blocks end, and the block of each."""
    number, doc_id, offset, ids, of = (pieces.field(i) for i in range(len(PIECE)))
    n = ids.to_numpy()
    end = np.cumsum(n)
    first, last = (end - n) // BLOCK, (end - 1) // BLOCK  # a piece has one id at least
    row = np.repeat(np.arange(len(n)), last - first + 1)
    block = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
    begin, stop = np.maximum((end - n)[row], block * BLOCK), np.minimum(end[row], (block + 1) * BLOCK)
    at = pa.array(row)
    columns = [number.take(at), doc_id.take(at), pa.array(offset.to_numpy()[row] + begin - (end - n)[row]), pa.array(stop - begin), of.take(at)]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in PIECE]), block


def chunks(docs: DataFrame, tokenizer: str, bits: bool = False, partitions: int | None = None) -> DataFrame:
    """(doc_id, text) to the rows of the chunk files, in ascending doc_id order over shards and chunks."""
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    dealt = dealt.sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk, number = TaskContext.get().partitionId(), 0, 0
        encoder = WordEncoder.of(tokenizer)
        left, held = np.zeros(0, np.uint32), _pieces(0, pa.array([], pa.int64()), np.zeros(0, np.int64))  # what doesn't fill a block yet

        def put(ids: np.ndarray, pieces: pa.StructArray) -> pa.RecordBatch:
            nonlocal chunk
            chunk += 1
            docs = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chunk - 1]), pa.array([len(ids)]), pa.array([pack(ids, bits)]), docs], schema=schema)

        for batch in _batches(batches):
            ids, counts = encoder.encode(batch.column("text"))
            flat = np.concatenate([left, ids])
            cut, block = _at_blocks(pa.concat_arrays([held, _pieces(number, batch.column("doc_id"), counts)]))
            number += len(counts)
            full = len(flat) // BLOCK
            edges = np.searchsorted(block, np.arange(full + 1))
            for i in range(full):
                yield put(flat[i * BLOCK : (i + 1) * BLOCK], cut.slice(edges[i], edges[i + 1] - edges[i]))
            left, held = flat[full * BLOCK :].copy(), pa.concat_arrays([cut.slice(edges[full])])
        if len(held):
            yield put(left, held)

    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("chunk_bytes", pa.binary()), ("docs", pa.list_(pa.struct(PIECE)))])
    return dealt.mapInArrow(write, CHUNK_SCHEMA)


def write_ids(docs: DataFrame, path: str, tokenizer: str, bits: bool = False, partitions: int | None = None) -> None:
    """Write the chunk files of ``docs`` to ``path``."""
    chunks(docs, tokenizer, bits, partitions).write.option("compression", "none").parquet(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of documents in chunk files: where each starts in its shard, and its ids as bytes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, chunk, held = (batch.column(c) for c in ("shard", "chunk", "docs"))
            for i, packed in enumerate(batch.column("chunk_bytes")):
                ids, docs = unpack(packed.as_py()).astype("<u4"), held[i].values
                n = docs.field("ids").to_numpy()
                ends = np.append(0, np.cumsum(n))
                data = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
                place = pa.array(chunk[i].as_py() * BLOCK + ends[:-1])
                of = [docs.field(name) for name, _ in PIECE]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard[i].as_py(), np.int32)), place, data, *of], schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("ids_bytes", pa.binary()), *PIECE])
    files = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    return files.mapInArrow(split, "shard int, place long, ids_bytes binary, number long, doc_id bigint, offset long, ids long, of long")


def read_ids(spark: SparkSession, path: str, whole_column: Column | None = None) -> DataFrame:
    """The documents of chunk files: doc_id, start (ids of all documents before it), n_tokens and ``whole_column``.

    ``whole_column`` is made of ids_bytes, the default. It is taken at once where a document lies in one chunk; only documents
    that cross a block border are put together again in a shuffle. All chunks of a shard but its last are full, so
    a chunk's number gives its place.
    """
    made = F.col("ids_bytes") if whole_column is None else whole_column
    index = spark.read.schema(CHUNK_SCHEMA).parquet(path).select("shard", "n_ids")
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("__n"))
    bases = materialize(totals.select("shard", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__base")))
    cut = F.col("ids") < F.col("of")
    pieces = read_pieces(spark, path).select("shard", "number", "doc_id", "of", "place", F.when(cut, F.struct("offset", "ids_bytes")).alias("part"), F.when(~cut, made).alias("made"))
    docs = pieces.groupBy("shard", "number", "doc_id", "of").agg(F.min("place").alias("place"), F.array_sort(F.collect_list("part")).alias("parts"), F.first("made", ignorenulls=True).alias("made"))
    joined = docs.withColumn("ids_bytes", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids_bytes"])))
    out = joined.join(bases, "shard").withColumn("start", F.col("__base") + F.col("place"))
    return out.select("doc_id", "start", F.col("of").alias("n_tokens"), F.when(F.size("parts") == 0, F.col("made")).otherwise(made).alias("made"))


def tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the ids of ``docs`` next to the checkpoints, read the files back and digest each document's ids."""
    path = scratch(spark, "token-ids")
    write_ids(docs, path, tokenizer, **options)
    return read_ids(spark, path, F.crc32("ids_bytes")).withColumnRenamed("made", "ids_crc32")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
