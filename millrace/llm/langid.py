"""Language identification with language-bitmask n-gram filters.

All languages share one Bloom filter that is sliced by bit: every slot holds one bit per language, and the AND of
an n-gram's slots gives the languages that contain it, all at once. The set bits are counted per language over a
text, corrected for the false positives that the language's share of set slots predicts, and the language with most
of the text's n-grams wins. The score is that corrected share, 0 to 1.

``fit`` counts the n-grams of at most about ``train_docs`` labelled documents per language (all of them where there
are fewer; picked by a hash, whole texts). A language contains an n-gram whose share of the language's n-grams is at
least ``min_share`` and at least ``min_ratio`` times its largest share in any language. The counts stay in Spark; only
the filter's slots come to the driver and go out to the tasks, at most ``2**SLOT_BITS`` rows at any input size.

N-grams are runs of 3 and 5 bytes of the lower-case text in which everything but letters is one space.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without training rows every text is;
ties go to the first language by code point; rows repeat as they come; other columns pass through, and columns of the
names that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import documents
from .wordhash import slices

SIZES = (3, 5)
SLOT_BITS = 20
HASHES = 2
UNKNOWN = "und"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass
class Filter:
    """``planes[i][slot]`` has bit j for language 8 i + j; ``false[l]`` is the chance that a foreign n-gram looks known."""

    languages: list[str]
    planes: np.ndarray
    false: np.ndarray


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with letters only, and the place of each text's first byte and of the end."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\pL]+", " ")
    letters = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), letters, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    letters = pc.fill_null(letters, "")
    offsets = np.frombuffer(letters.buffers()[1], np.int64)[letters.offset : letters.offset + len(letters) + 1]
    data = letters.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def grams(raw: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that lie in one text, one after the other, and how many each text has."""
    n = max(len(raw) - size + 1, 0)
    code = np.zeros(n, np.uint64)
    for i in range(size):
        code |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    code |= np.uint64(size << 56)
    per_text = np.maximum(np.diff(ends) - size + 1, 0)
    inside = np.ones(len(raw) + 1, bool)
    for i in range(1, size):  # n-grams that begin in the last bytes of a text reach into the next one
        at = ends[1:] - i
        inside[at[at >= ends[:-1]]] = False
    return code[inside[:n]], per_text


def slots(code: np.ndarray) -> list[np.ndarray]:
    return [((code * np.uint64(m)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in MULTIPLIERS[:HASHES]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the n-gram counts of a slice of rows."""
    for batch in slices(batches):
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for lang in sorted(set(langs)):
            raw, ends = _cut(batch.column("text").filter(pa.array(langs == lang)))
            for size in SIZES:
                code, n = np.unique(grams(raw, ends, size)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])


def fit(docs: DataFrame, train_docs: int = 2000, min_share: float = 2e-6, min_ratio: float = 0.1) -> Filter:
    """Learn from (doc_id, text, lang): rows with a text and a lang, at most about ``train_docs`` of each language."""
    known = docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return Filter([], np.zeros((0, 1 << SLOT_BITS), np.uint8), np.zeros(0))
    languages = sorted(sizes)
    limit = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, train_docs / sizes[lang])))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    counted = (
        known.filter(place < limit[F.col("lang")]).select("lang", "text").mapInArrow(_counts, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    size = F.shiftrightunsigned("code", 56)
    bit = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    totals = counted.groupBy("lang", size.alias("size")).agg(F.sum("n").alias("of"))
    shares = counted.withColumn("size", size).join(F.broadcast(totals), ["lang", "size"])  # a row per language and size
    shares = shares.select("code", bit[F.col("lang")].alias("bit"), (F.col("n") / F.col("of")).alias("share"))
    best = shares.groupBy("code").agg(F.max("share").alias("best"), F.collect_list(F.struct("bit", "share")).alias("all"))
    kept = best.select("code", F.expr(f"transform(filter(all, x -> x.share >= {min_share} and x.share >= {min_ratio} * best), x -> x.bit)").alias("bits"))
    kept = kept.filter(F.size("bits") > 0)

    def place_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").to_numpy().view(np.uint64)
            for slot in slots(code):
                yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column("bits")], ["slot", "bits"])

    by_slot = kept.mapInArrow(place_bits, "slot long, bits array<int>").select("slot", F.explode("bits").alias("bit"))
    masks = by_slot.groupBy("slot", F.floor(F.col("bit") / 8).alias("plane")).agg(F.bit_or(F.expr("shiftleft(1, bit % 8)")).alias("mask")).toPandas()
    planes = np.zeros((-(-len(languages) // 8), 1 << SLOT_BITS), np.uint8)
    planes[masks["plane"], masks["slot"]] = masks["mask"]
    filled = np.array([(planes[i // 8] >> (i % 8) & 1).mean() for i in range(len(languages))])
    return Filter(languages, planes, filled**HASHES)


def score(model: Filter, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    raw, ends = _cut(texts)
    spaces = np.concatenate([[0], np.cumsum(raw != 0x20)])
    lettered = spaces[ends[1:]] > spaces[ends[:-1]]
    known, total = np.zeros((len(model.languages), len(texts))), np.zeros(len(texts))
    for size in SIZES:
        code, n = grams(raw, ends, size)
        total += n
        stop = np.cumsum(n)
        places = slots(code)
        for p, plane in enumerate(model.planes):
            mask = plane[places[0]]
            for at in places[1:]:
                mask &= plane[at]
            for b in range(min(8, len(model.languages) - 8 * p)):
                hits = np.concatenate([[0], np.cumsum(mask >> np.uint8(b) & np.uint8(1), dtype=np.int64)])
                known[8 * p + b] += hits[stop] - hits[stop - n]
    if not model.languages:
        return [UNKNOWN] * len(texts), total * 0.0
    false = model.false[:, None]
    share = np.clip((known - false * total) / (1 - false) / np.maximum(total, 1), 0, 1)
    best = share.argmax(axis=0)
    names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, share.max(axis=0), 0.0)


def identify(docs: DataFrame, model: Filter, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with language and score under ``names``; only the text is looked at."""
    rows = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, value = score(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(value)], [*batch.schema.names, *names])

    return rows.mapInArrow(predict, schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
