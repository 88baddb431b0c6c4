"""Substring deduplication by De Bruijn compaction.

Edges of the graph are the k-mers of words that occur more than once (``size`` words, 20 by default), nodes their overlaps. Every edge is
joined with its first source: the smallest doc_id that has it. Edges that follow each other in a document and have
the same first source form a path without branches, and such paths are compacted into spans: document, first word,
words, source. The words of all spans of a document are removed, and those of k-mers that stand earlier in the same document.

Only k-mers that can repeat become rows. Each k-mer has an anchor, the least hash among its short runs of ``ANCHOR``
words, which equal k-mers share; about one word in eight is an anchor. Anchors are counted over all documents, those
that occur in one place only are dropped, and the k-mers of the others are the candidates. This is exact: an equal pair of
k-mers has an equal anchor in both places. Edges carry two independent 64-bit hashes, and both must agree.

Documents with the same words are compared once: all but the first one lose every word that lies in a window.
Hot k-mers and texts do no harm: sources are minima, which combine before the shuffle, and joins have one row per
k-mer on the other side, so AQE can split them. What meets in one task is at most one document's spans.

Defined cases: null and empty texts have no words and keep the hash of the empty text; documents of fewer than ``size`` words
lose nothing; a null doc_id counts as smaller than all others; rows with the same doc_id and text are one document that
comes more than once, they remove nothing from each other and get equal results; rows with one doc_id and
different texts are neither's source; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, n_words, release, whole
from .wordhash import in_one_text, mixed, slices, windows, words

SIZE = 20
ANCHOR = 7
LEAST_ID = -(1 << 63)
ODD_SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def _anchored(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, text, anchor and the anchor's place of every k-mer."""
    places, text = in_one_text(first, size)
    if not len(places):
        return places, text, np.zeros(0, np.uint64), places
    anchor = min(ANCHOR, size)
    runs = windows(hashes, anchor)
    at = sliding_window_view(runs, size - anchor + 1).argmin(axis=1)[places] + places
    return places, text, runs[at], at


def _anchors(size: int):
    schema = pa.schema([("anchor", pa.int64()), ("text_id", pa.int64()), ("again", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column("text"))
            _, text, anchor, at = _anchored(w.hashes, w.first, size)
            if not len(at):
                continue
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
            text, anchor = text[new], anchor[new]
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            same = (text[1:] == text[:-1]) & (anchor[1:] == anchor[:-1])
            keep, again = np.concatenate([[True], ~same]), np.zeros(len(text), bool)
            again[:-1] = same
            ids = batch.column("text_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), pa.array(ids[text[keep]]), pa.array(again[keep])], schema=schema)

    return find, "anchor long, text_id long, again boolean"


def _edges(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("again", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column("text"))
            places, text, anchor, _ = _anchored(w.hashes, w.first, size)
            lists = batch.column("anchors")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            wanted = lists.flatten().to_numpy().view(np.uint64)
            # is (text, anchor) among the (text, anchor) of the lists? one mixed number each; a rare false yes only makes a candidate
            name = lambda t, a: mixed(a + mixed(t.astype(np.uint64) + np.uint64(1)))
            keep = np.isin(name(text, anchor), name(owner, wanted))
            places, text = places[keep], text[keep]
            h = windows(w.hashes, size)[places]
            g = windows(mixed(w.hashes ^ np.uint64(0xA24BAED4963EE407)), size)[places]
            order = np.lexsort((places, g, h, text))
            again = np.zeros(len(places), bool)
            a, b = order[:-1], order[1:]
            again[b] = (text[a] == text[b]) & (h[a] == h[b]) & (g[a] == g[b])
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text_id").to_numpy()
            start = (places - w.first[text]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(texts[text]), pa.array(start), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(again)], schema=schema)

    return find, "doc_id long, text_id long, start int, h long, g long, again boolean"


def repeated_spans(docs: DataFrame, first: DataFrame, size: int = SIZE) -> DataFrame:
    """The compacted paths of ``docs`` (doc_id, text_id, text): doc_id, text_id, start, n_words, source.

    ``first`` (doc_id, text_id) names the documents that are compared, one for each run of words. ``source`` is the
    document that has the span first, which is the document itself for spans that it repeats.
    """
    spark = docs.sparkSession
    anchors = docs.select("text", "text_id").mapInArrow(*_anchors(size))
    counted = anchors.groupBy("anchor").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b"), F.max("again").alias("again"))
    shared = materialize(counted.filter("a != b or again").select("anchor"))
    release(spark)
    # a set: copies of a text have the same anchors, and a buffer holds those of one text however many copies there are
    of_text = anchors.select("anchor", "text_id").join(shared, "anchor").groupBy("text_id").agg(F.collect_set("anchor").alias("anchors"))
    wanted = materialize(of_text.join(first, "text_id"))
    release(spark)
    edges = materialize(docs.join(wanted, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "anchors").mapInArrow(*_edges(size)))
    release(spark)
    once = edges.filter("not again")
    sources = once.groupBy("h", "g").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last")
    sources = materialize(sources.select("h", "g", "source"))
    later = once.join(sources, ["h", "g"]).filter("doc_id > source").select("doc_id", "text_id", "start", "source")
    repeated = later.unionByName(edges.filter("again").select("doc_id", "text_id", "start", F.col("doc_id").alias("source")))
    along = Window.partitionBy("doc_id", "text_id", "source").orderBy("start")
    paths = repeated.withColumn("path", F.col("start") - F.row_number().over(along))
    spans = paths.groupBy("doc_id", "text_id", "source", "path").agg(F.min("start").alias("start"), (F.count("*") + size - 1).alias("n_words"))
    return spans.select("doc_id", "text_id", "start", "n_words", "source")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words of the spans of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
    for batch in slices(batches):
        w, rows = words(batch.column("text")), []
        for k, (doc, text, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "spans")), strict=True)):
            begin, end = w.begin[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]]
            edge = np.zeros(len(begin) + 1, np.int64)
            np.add.at(edge, [s["start"] for s in spans], 1)
            np.add.at(edge, [s["start"] + s["n_words"] for s in spans], -1)
            stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            kept = b" ".join([w.raw[a:b].tobytes() for a, b in zip(begin[stay].tolist(), end[stay].tolist(), strict=True)])
            rows.append({"doc_id": doc, "text_id": text, "n_removed": len(begin) - len(stay), "kept": kept})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def deduplicate(docs: DataFrame, size: int = SIZE, of: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """(doc_id, text) to doc_id, n_words, n_removed and kept, one row per input row.

    ``kept`` is ``of`` the words that stay, joined by one space: the text itself, or say a digest. It is applied
    before the rows are joined, so with a digest only documents that lose words are shuffled with their text.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.xxhash64(whole()).alias("text_id"), whole().alias("text"))
    plain = F.trim(F.regexp_replace("text", ODD_SPACE, " "))
    slim = rows.withColumn("plain", plain).select("doc_id", "text_id", n_words().alias("n_words"), F.sha2("plain", 256).alias("same"), of(F.col("plain")).alias("own"))
    slim = materialize(slim)
    least = slim.groupBy("same").agg(F.min("doc_id").alias("least"))
    slim = materialize(slim.join(least, "same").withColumn("copy", F.col("doc_id") > F.col("least")).drop("least", "same"))
    first = slim.filter(f"not copy and n_words >= {size}").select("doc_id", "text_id").distinct()
    spans = materialize(repeated_spans(rows, first, size))
    lists = spans.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    cut = rows.join(lists, ["doc_id", "text_id"]).mapInArrow(_cut, "doc_id long, text_id long, n_removed long, kept binary")
    cut = cut.groupBy("doc_id", "text_id").agg(F.first("n_removed").alias("n_removed"), F.first(of(F.col("kept").cast("string"))).alias("kept"))
    out = slim.join(cut, ["doc_id", "text_id"], "left")
    gone = F.col("copy") & (F.col("n_words") >= size)
    return out.select(
        F.nullif("doc_id", F.lit(LEAST_ID)).alias("doc_id"), "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, of(F.lit(""))).otherwise(F.coalesce("kept", "own")).alias("kept"),
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(documents(spark, sf_dir), of=lambda text: F.sha2(text, 256))
    return out.withColumnRenamed("kept", "kept_sha256")


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) as k from w, unnest(range(1, len(ws) - 18)) t(i)),
firsts as (select k, min((doc_id, i)) as f from windows group by k having count(*) > 1),
gone as (select doc_id, list(distinct j) as js from windows join firsts using (k), unnest(range(i, i + 20)) u(j) where (doc_id, i) > f group by doc_id),
kept as (select doc_id, len(ws)::bigint as n_words,
    case when js is null then ws else list_filter(ws, lambda x, n: not list_contains(js, n)) end as ks
  from w left join gone using (doc_id))
select doc_id, n_words, n_words - len(ks)::bigint as n_removed, sha256(array_to_string(ks, ' ')) as kept_sha256 from kept
"""
