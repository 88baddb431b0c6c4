"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if some run of its words is within the item's error budget: a tenth of the
item's words, counted as edits of words. An item is cut into one piece more than its budget, so at least one piece
stands unchanged in any such run. The first words of all pieces are found in the documents by hash, whole pieces are
compared, and the stretches of the document around the hits are verified with Myers' bit-parallel distance over
words. Overlapping stretches are joined, so the work for an item and a document is at most the document's length.

Words are compared in lower case and without signs, so changed case, punctuation or decoration costs no edits.

The items go out to the tasks in blocks of ``block_items``: a larger benchmark takes more passes, no larger broadcast.
Documents are read once per block, nothing is shuffled, and a document is never compared with another.

An item with fewer than ``min_words`` words is searched in letters where its script has no spaces between words: each such letter
counts as a word, in the item and in the documents, and so do the budget, ``end_word`` and ``n_words``. With under ten
of these units the budget is 0, and the item's whole run must stand in the document unchanged.

Defined cases: null or empty texts have no words and no hits; repeated documents and repeated items each give their own rows, also under one id; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .wordhash import in_one_text, mixed, slices, windows, words

RATE = 0.1
MIN_WORDS = 5
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Letters of scripts that put no spaces between words.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"
SCHEMA = "doc_id long, item_id long, distance int, budget int, end_word long, n_words long"


def plain(texts: pa.Array) -> pa.Array:
    """Lower case, without characters other than letters, digits and white space."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pN\x20\x09-\x0D]+", "")


def lettered(texts: pa.Array) -> pa.Array:
    """``plain``, with every letter of an unspaced script as a word of its own."""
    return pc.replace_substring_regex(plain(texts), UNSPACED, r" \1 ")


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """For every end in ``text`` the fewest edits that turn ``pattern`` into words that end there.

    The vertical differences of a column of the edit table are two bit vectors as long as the pattern, and a
    column follows from the last one by a few operations on whole vectors.
    """
    m = len(pattern)
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        places[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for w in text:
        eq = places.get(w, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq) & full
        vertical = eq | minus
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full  # any place may begin a match: the top row stays 0
        plus, minus = down | (~(vertical | up) & full), up & vertical
        out.append(score)
    return out


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` even parts of ``n`` words, as (first word, words)."""
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Items:
    """A block of test items: their words' hashes, and the pieces by the hash of their first words."""

    def __init__(self, ids: list[int], texts: list[str | None], rate: float, min_words: int, view=plain):
        self.view = view
        w = words(view(pa.array(texts, pa.string())))
        self.ids = ids
        self.words = [w.hashes[w.first[k] : w.first[k + 1]].tolist() for k in range(len(ids))]
        self.budget = [int(rate * len(own)) for own in self.words]
        cut = [(k, at, n) for k, own in enumerate(self.words) if len(own) >= min_words for at, n in pieces(len(own), self.budget[k])]
        #: so many words of each piece are looked up; with the default rate and ``min_words`` no piece has fewer than five
        self.probe = min([min_words, *(n for _, _, n in cut)])
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, at, n in cut:
            found[int(windows(np.array(self.words[k][at : at + self.probe], np.uint64), self.probe)[0])].append((k, at, n))
        self.found = dict(found)
        keys = np.array(sorted(found), np.uint64)
        self.bits = 12
        while 1 << self.bits < 64 * len(keys):
            self.bits += 1
        self.marks = np.zeros(1 << self.bits, bool)
        self.marks[(mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places begin with the first words of a piece, up to chance, and the hashes there."""
        h = windows(hashes, self.probe)[places] if len(places) else np.zeros(0, np.uint64)
        maybe = np.flatnonzero(self.marks[(mixed(h) >> np.uint64(64 - self.bits)).astype(np.int64)])
        return maybe, h[maybe]


def all_items(ids: list[int], texts: list[str | None], rate: float, min_words: int) -> list[Items]:
    """The items by how they are searched: long ones in words, short ones in letters, each with as long a probe as it allows."""
    w, short = words(plain(pa.array(texts, pa.string()))), words(lettered(pa.array(texts, pa.string())))
    groups: dict[tuple, list[int]] = defaultdict(list)
    for k, (n, units) in enumerate(zip(np.diff(w.first).tolist(), np.diff(short.first).tolist(), strict=True)):
        if n >= min_words:
            groups[min_words, plain].append(k)
        elif units:
            groups[min(min_words, *(x for _, x in pieces(units, int(rate * units)))), lettered].append(k)
    return [Items([ids[k] for k in ks], [texts[k] for k in ks], rate, least, view) for (least, view), ks in groups.items()]


def search_all(groups: list[Items], batch: pa.RecordBatch) -> list[dict]:
    return [hit for items in groups for hit in search(items, batch)]


def search(items: Items, batch: pa.RecordBatch) -> list[dict]:
    """Matches of a batch of documents; ``at`` is the row."""
    w = words(items.view(batch.column("text")))
    places, text = in_one_text(w.first, items.probe)
    maybe, keys = items.hits(w.hashes, places)
    stretches: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for at, doc, key in zip(places[maybe].tolist(), text[maybe].tolist(), keys.tolist(), strict=True):
        for k, offset, n in items.found.get(key, ()):
            own, budget = items.words[k], items.budget[k]
            if at + n <= w.first[doc + 1] and w.hashes[at : at + n].tolist() == own[offset : offset + n]:
                begin = max(at - offset - budget, int(w.first[doc]))
                stretches[doc, k].append((begin, min(at - offset + len(own) + budget, int(w.first[doc + 1]))))
    ids, out = batch.column("doc_id").to_pylist(), []
    for (doc, k), spans in sorted(stretches.items()):
        best = None
        spans.sort()
        begin, end = spans[0]
        joined = []
        for a, b in spans[1:]:
            if a > end:
                joined.append((begin, end))
                begin, end = a, b
            end = max(end, b)
        for begin, end in [*joined, (begin, end)]:
            scores = myers(items.words[k], w.hashes[begin:end].tolist())
            least = min(scores)
            if least <= items.budget[k] and (best is None or least < best[0]):
                best = (least, begin + scores.index(least) + 1 - int(w.first[doc]))
        if best:
            out.append({"at": doc, "doc_id": ids[doc], "item_id": items.ids[k], "distance": best[0], "budget": items.budget[k], "end_word": best[1], "n_words": len(items.words[k])})
    return out


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[tuple[list[int], list[str | None]]]:
    """The items in blocks of bounded number and bytes, one partition after the other."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text or "")
        if len(ids) >= block_items or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Each document and item that match: fewest edits, the item's budget and words, and the word after the best match's end."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("end_word", pa.int64()), ("n_words", pa.int64())])
    rows, out = docs.select("doc_id", "text"), None
    for ids, texts in _blocks(benchmark, block_items):
        shared = spark.sparkContext.broadcast((ids, texts))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = all_items(*shared.value, rate, min_words)
            for batch in slices(batches):
                if found := search_all(items, batch):
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

        part = rows.mapInArrow(find, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` that no test item matches, with all their columns."""
    for ids, texts in _blocks(benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = all_items(*shared.value, rate, min_words)
            for batch in slices(batches):
                stay = np.ones(batch.num_rows, bool)
                stay[[hit["at"] for hit in search_all(items, batch)]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
