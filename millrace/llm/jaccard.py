"""N-gram Jaccard join by banded MinHash LSH, in place of an LSH forest, and exact verification.

Texts are sets of shingles of five words; two are linked if the Jaccard similarity of their sets is at least 0.8. There
are ``TREES`` bands of MinHash values. Two texts meet where all values of a band agree; the length of the bands is the
longest, from ``DEEPEST`` values down, at which texts at the threshold meet with the target recall, the least recall of
any link. A formula gives it, not the data. Whatever meets is verified on the whole shingle sets.

Texts with the same words are one class and compared once. Classes that meet directly or by others are a
neighbourhood. Small neighbourhoods are verified whole, many to a task. In large ones every shared prefix is a group of
its own, cut into blocks of about ``BLOCK`` units of weight, a task for each pair of blocks; a pair is counted at the
first prefix that it shares. A class weighs one unit and one more for each ``UNIT`` bytes of its text, as the shingles of
a task's texts lie in memory together. So no task holds more than about two blocks (a text above a block's weight fills one alone),
no pair of texts is ever a row, and a group of copies costs no more than one text. Tasks return numbers of links and the links' components as
stars; components are joined over all tasks.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; null and empty texts have no shingle,
link with nothing and are a class each; rows that repeat are copies; a null doc_id counts as the smallest; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, documents, release, whole
from .graph import components
from .substrings import LEAST_ID, ODD_SPACE
from .wordhash import in_one_text, mixed, slices, windows, words

SHINGLE = 5
SIMILARITY = 0.8
TREES = 32
DEEPEST = 10
RECALL = 0.9999
BLOCK = 512
UNIT = 8192


def depth_for(similarity: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which two texts of this similarity share one in some tree with at least this probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles one after the other, repeats included, and each text's first one (and the end)."""
    w = words(texts)
    places, text = in_one_text(w.first, SHINGLE)
    found = windows(w.hashes, SHINGLE)[places] if len(places) else np.zeros(0, np.uint64)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        own = np.array([windows(w.hashes[w.first[k] : w.first[k + 1]], int(counts[k]))[0] + np.uint64(counts[k]) for k in short], np.uint64)
        order = np.argsort(np.concatenate([text, short]), kind="stable")
        found, text = np.concatenate([found, own])[order], np.concatenate([text, short])[order]
    return found, np.searchsorted(text, np.arange(len(counts) + 1))


def _signatures(depth: int, trees: int):
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 31, (trees, depth, 2), np.uint32) * np.uint32(2) + np.uint32(1)
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, first = shingles(batch.column("text"))
            some = np.flatnonzero(np.diff(first))
            if not len(some):
                continue
            low, high, starts = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32), first[some]
            keys = np.empty((len(some), trees), np.uint64)
            for t in range(trees):
                key = np.full(len(some), t + 1, np.uint64)
                for a, b in factors[t]:
                    key = mixed(key ^ np.minimum.reduceat(low * a + high * b, starts).astype(np.uint64))
                keys[:, t] = key
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, trees, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(some)) for c in ("doc_id", "text_id")] + [lists], schema=schema)

    return sign, "doc_id long, text_id long, keys array<long>"


def overlaps(found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of shared shingles of all pairs of texts, and of each text's different shingles."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((text, found))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    found, text = found[new], text[new]
    size = np.bincount(text, minlength=n)
    head = np.ones(len(found), bool)
    head[1:] = found[1:] != found[:-1]
    column = np.cumsum(head) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one text adds nothing
    text, column = text[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    common, width = np.zeros((n, n), np.float32), 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            rows, inverse = np.unique(text[a:b], return_inverse=True)
            has = np.zeros((len(rows), width), np.float32)
            has[inverse, column[a:b] - k * width] = 1
            common[np.ix_(rows, rows)] += has @ has.T
    return common, size


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        new, low = root.copy(), np.minimum(root[i], root[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(similarity: float):
    schema = pa.schema([("node", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])

    def verify(table: pa.Table) -> pa.Table:
        _, each = np.unique(table["node"].to_numpy(), return_index=True)  # a row of the input may repeat
        table = table.take(pa.array(each))
        node, n, block = (table[c].to_numpy() for c in ("node", "n", "block"))
        common, size = overlaps(*shingles(table["text"].combine_chunks()))
        linked = common / np.maximum(size[:, None] + size - common.astype(np.int64), 1) >= similarity
        i, j = np.nonzero(np.triu(linked, 1))
        if len(i) and table["forest"][0].as_py():
            # a group of one shared prefix: pairs of its two blocks, unless they share an earlier prefix
            keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            own = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == table["key"][0].as_py()
            if table["p"][0].as_py() != table["q"][0].as_py():
                own &= block[i] != block[j]
            i, j = i[own], j[own]
        if not len(i):
            return schema.empty_table()
        count = np.bincount(i, weights=n[j], minlength=len(node)) + np.bincount(j, weights=n[i], minlength=len(node))
        root, some = _stars(i, j, len(node)), np.unique(np.concatenate([i, j]))
        return pa.table([node[some], count[some].astype(np.int64), node[root[some]]], schema=schema)

    return verify, "node long, n_links long, root long"


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, text) to doc_id, text_id, class_id, n_links and kept, one row per input row.

    ``class_id`` is the smallest doc_id that is reached by links, ``n_links`` the number of other rows that are linked directly,
    ``kept`` is true for the document and text that stand for their class.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.xxhash64(whole()).alias("text_id"), whole().alias("text"))
    plain = F.trim(F.regexp_replace("text", ODD_SPACE, " "))
    slim = materialize(rows.withColumn("plain", plain).select("doc_id", "text_id", F.when(F.col("plain") != "", F.sha2("plain", 256)).alias("same"), F.octet_length("text").alias("bytes")))
    weight = (F.min_by("bytes", "doc_id") / UNIT + 1).cast("long").alias("weight")
    classes = slim.filter("same is not null").groupBy("same").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min_by("text_id", "doc_id").alias("text_id"), weight)
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))

    # where classes meet
    sign = _signatures(depth_for(similarity, recall), TREES)
    signed = rows.mapInArrow(*sign).join(classes.select("doc_id", "text_id", "node", "weight"), ["doc_id", "text_id"])
    signed = materialize(signed.select("node", "weight", "keys").dropDuplicates(["node"]))
    at = signed.select("node", "weight", F.explode("keys").alias("key"))
    shared = at.groupBy("key").agg(F.count("*").alias("texts"), F.sum("weight").alias("m"), F.min("node").alias("head")).filter("texts > 1")
    met = materialize(at.drop("weight").join(materialize(shared.drop("texts")), "key"))
    release(spark)
    near = components(met.select(F.col("node").alias("a"), F.col("head").alias("b")))
    near = near.join(classes.select("node", "weight"), "node")
    sizes = near.groupBy("root").agg(F.sum("weight").alias("size"))
    near = materialize(near.join(sizes, "root"))
    small, large = near.filter(F.col("size") <= BLOCK), near.filter(F.col("size") > BLOCK)
    bins = max(2 * (small.agg(F.sum("weight")).first()[0] or 0) // BLOCK, 1)

    # what is verified together
    zero, none = F.lit(0), F.lit(None).cast("array<long>")
    whole_ones = small.select("node", F.pmod(F.xxhash64("root"), F.lit(bins)).alias("key"), zero.alias("p"), zero.alias("q"), zero.alias("block"), none.alias("keys"), F.lit(False).alias("forest"))
    blocks = met.join(large.select("node"), "node").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    blocks = blocks.join(signed, "node").select("node", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "keys", F.lit(True).alias("forest"))
    texts = rows.join(near.drop("weight").join(classes, "node").select("doc_id", "text_id", "node", "n"), ["doc_id", "text_id"]).select("node", "n", "text")
    groups = whole_ones.unionByName(blocks).join(materialize(texts), "node")
    verify, schema = _verify(similarity)
    found = materialize(groups.groupBy("forest", "key", "p", "q").applyInArrow(verify, schema))
    release(spark)

    # components and numbers of links, back to the rows
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = roots.join(classes, "node").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("text_id", "doc_id").alias("class_text"))
    linked = roots.join(least, "root").join(counts, "node").select("node", "class_id", "class_text", "n_links")
    of_class = classes.join(linked, "node", "left").select("same", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_text", "text_id").alias("class_text"), (F.coalesce("n_links", zero) + F.col("n") - 1).alias("n_links"))
    out = slim.join(of_class, "same", "left")
    null = lambda c: F.nullif(c, F.lit(LEAST_ID))
    kept = F.col("same").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("text_id") == F.col("class_text")))
    links = F.coalesce("n_links", zero).cast("long").alias("n_links")
    return out.select(null(F.col("doc_id")).alias("doc_id"), "text_id", null(F.coalesce("class_id", "doc_id")).alias("class_id"), links, kept.alias("kept"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns; rows without words all stay.

    The rows are found by doc_id and text; where such a row repeats, one of them stays.
    """
    keep = near_duplicates(docs, **options).filter("kept").select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("__doc"), F.col("text_id").alias("__text"))
    keyed = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))).withColumn("__text", F.xxhash64(whole()))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    once = keyed.filter(worded).join(materialize(keep.distinct()), ["__doc", "__text"]).dropDuplicates(["__doc", "__text"])
    return once.select(*docs.columns).unionByName(docs.filter(~worded))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ')) as s from w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) where len(ws) > 0),
sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
pairs as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c / (x.n + y.n - c)::double >= 0.8),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, (select min(b) from reach where a = doc_id) as class_id, (select count(*) from links where a = doc_id) as n_links from documents
"""
