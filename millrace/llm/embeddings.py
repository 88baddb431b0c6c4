"""Embedding near-duplicates over an inverted multi-index.

Vectors are cut into halves, each half has its own codebook, and a pair of codes is a cell of the product grid. Every
vector is a member of the cell of its two nearest codes, and meets the members of all cells that can hold a partner.
A cell can't hold one where the vector's distance to the cell's border alone is too large: a code's region lies beyond the planes half-way
between it and every other code, and the two halves' distances add up. That bound is exact, so no link is lost.
What is met is verified with the exact cosine in double precision.

Cells that follow each other form a range, so many that a label has about ``BLOCK`` vectors in each; a label with fewer
has a single range. A vector visits a range once for all cells in it, and only ranges from its own one on, so a pair of two ranges is met once.

Equal vectors with one label are one class with a number of copies and are compared once. A range's members and
visitors are cut into blocks of about ``BLOCK``, and each pair of blocks is one group: a dense cell becomes many tasks,
and no pair is ever a row. A group returns how many vectors each class links with and the links' components as stars. A pair within
one range is met twice, once from either side, and counts for the visitor only.

Only the codebooks and their sample are bounded. Broadcast are the codebooks, a number per cell and one per label of more than ``BLOCK`` vectors.

Defined cases: a vector links with nothing if its label or vec_id is null, or if it is null, empty, zero, or holds a
null or non-finite component; vectors of different lengths never link; rows that repeat count as
copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components

COSINE = 0.93
RECALL = 0.999
TRAIN_ROWS = 10_000
BLOCK = 1024
#: So many pairs of a vector and a cell are tested at a time.
TESTS = 4_000_000


@dataclass
class Index:
    """Two codebooks and the distances between their codes."""

    books: list[np.ndarray]
    apart: list[np.ndarray]


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means of a bounded sample; starts from its rows at even steps."""
    book = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = ((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)
        n = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, x)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def _squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ book.T + (book**2).sum(axis=1), 0)


def _borders(d: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """At least the squared distance to each code's region, from the squared distances to the codes.

    A region lies behind the planes half-way between its code and each other one; the farthest of them counts.
    """
    out = np.zeros_like(d)
    for c in range(d.shape[1]):
        # equal codes have no plane between them
        plane = np.divide(d - d[:, c, None], 2 * apart[c], out=np.zeros_like(d), where=apart[c] > 1e-6)
        np.maximum(out, plane, out=out)
    return out**2


def _distances(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit vector's squared distances to the codes of either half, and its own cell."""
    half = index.books[0].shape[1]
    a, b = _squared(x[:, :half], index.books[0]), _squared(x[:, half:], index.books[1])
    return a, b, a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)


def visited(index: Index, x: np.ndarray, ranges: np.ndarray, radius2: float) -> tuple[np.ndarray, list[list[int]]]:
    """Each unit vector's own range, and the ranges from its own one on with a cell that can hold a partner.

    ``ranges`` has the range of each cell, ascending; ``radius2`` is the largest squared distance of a partner.
    """
    names, starts = np.unique(ranges, return_index=True)
    own, out = [], []
    step = max(TESTS // len(ranges), 1)
    for at in range(0, len(x), step):
        a, b, cell = _distances(index, x[at : at + step])
        mine = ranges[cell]
        own += mine.tolist()
        if len(names) == 1:
            out += [[n] for n in mine.tolist()]
            continue
        far = _borders(a, index.apart[0])[:, :, None] + _borders(b, index.apart[1])[:, None, :]
        reach = np.logical_or.reduceat((far <= radius2 + 1e-9).reshape(len(cell), -1), starts, axis=1) & (names > mine[:, None])
        out += [[n, *names[there].tolist()] for n, there in zip(mine.tolist(), reach, strict=True)]
    return np.array(own, np.int64), out


def _valid() -> Column:
    numbers = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & numbers & F.exists("embedding", lambda x: x != 0)


def fit(classes: DataFrame, train_rows: int = TRAIN_ROWS) -> Index | None:
    """Codebooks from at most ``train_rows`` vectors."""
    total = classes.count()
    if not total:
        return None
    sample = classes.orderBy(F.xxhash64(F.lit(1), "node")).limit(train_rows).select("embedding").collect()
    x = unit(np.array([r.embedding for r in sample]))
    half, k = max(x.shape[1] // 2, 1), int(min(512, max(4, 2 * total**0.25)))
    books = [_means(part, min(k, len(part))) for part in (x[:, :half], x[:, half:])]
    return Index(books, [np.sqrt(_squared(b, b)) for b in books])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _shares(classes: DataFrame, index: Index) -> np.ndarray:
    """For each cell the share of the vectors that lie in cells before it."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def own(batches):
        for batch in batches:
            cell = [_distances(shared.value, unit(_matrix(batch.slice(at, 2048).column("embedding"))))[2] for at in range(0, batch.num_rows, 2048)]
            if cell:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).astype(np.int64))], ["cell"])

    n = np.zeros(len(index.books[0]) * len(index.books[1]))
    for r in classes.select("embedding").mapInArrow(own, "cell long").groupBy("cell").count().collect():
        n[r["cell"]] = r["count"]
    return (np.cumsum(n) - n) / n.sum()


def links(classes: DataFrame, index: Index, cosine: float) -> DataFrame:
    """(node, n_links, root): for each class and group the copies that it links with there, and a star of the links."""
    radius2, share = 2 - 2 * cosine, _shares(classes, index)
    n_ranges = {r.label: -(-r.n // BLOCK) for r in classes.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).collect()}
    shared = classes.sparkSession.sparkContext.broadcast((index, share, n_ranges))

    def place(batches):
        index, share, n_ranges = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, n = unit(_matrix(part.column("embedding"))), np.array([n_ranges.get(v, 1) for v in part.column("label").to_pylist()])
                own, visits = np.zeros(len(x), np.int64), [[0]] * len(x)
                for some in np.unique(n[n > 1]).tolist():
                    rows = np.flatnonzero(n == some)
                    own[rows], found = visited(index, x[rows], (share * some).astype(np.int64), radius2)
                    for row, there in zip(rows.tolist(), found, strict=True):
                        visits[row] = there
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own), pa.array(visits, pa.list_(pa.int64()))], [*part.schema.names, "own", "visits"])

    placed = materialize(classes.mapInArrow(place, "node long, label int, embedding array<float>, n long, least long, own long, visits array<long>".replace("label int", f"label {dict(classes.dtypes)['label']}")))
    members = placed.groupBy("label", F.col("own").alias("range")).agg(F.count("*").alias("m"))
    visitors = placed.select("label", F.explode("visits").alias("range")).groupBy("label", "range").agg(F.count("*").alias("v"))
    # one row per range that has members
    grid = materialize(members.join(visitors, ["label", "range"]).select("label", "range", F.ceil(F.col("m") / BLOCK).alias("mb"), F.ceil(F.col("v") / BLOCK).alias("vb")))
    row = ["node", "embedding", "n", "own"]
    spread = lambda c, n: F.pmod(F.xxhash64("node"), F.col(n)).alias(c)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = placed.withColumn("range", F.col("own")).join(grid, ["label", "range"]).select("label", "range", F.lit(True).alias("member"), *row, spread("mi", "mb"), every("vb").alias("vi"))
    here = placed.withColumn("range", F.explode("visits")).join(grid, ["label", "range"]).select("label", "range", F.lit(False).alias("member"), *row, every("mb").alias("mi"), spread("vi", "vb"))
    schema = pa.schema([("node", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        is_member = table["member"].to_numpy()
        node, n, own = (table[c].to_numpy() for c in ("node", "n", "own"))
        x = unit(_matrix(table["embedding"].combine_chunks()))
        m, v = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        if not len(m) or not len(v):
            return schema.empty_table()
        i, j = np.nonzero(x[v] @ x[m].T >= cosine)
        i, j = v[i], m[j]
        keep = node[i] != node[j]
        i, j = i[keep], j[keep]
        if not len(i):
            return schema.empty_table()
        # within one range the member is a visitor too: the pair is met from its side as well
        met = own[i] == own[j]
        count = np.bincount(i, weights=n[j], minlength=len(node)) + np.bincount(j[~met], weights=n[i[~met]], minlength=len(node))
        root = _stars(i, j, len(node))
        some = np.unique(np.concatenate([i, j]))
        return pa.table([node[some], count[some].astype(np.int64), node[root[some]]], schema=schema)

    rows = there.unionByName(here)
    return rows.groupBy("label", "range", "mi", "vi").applyInArrow(compare, "node long, n_links long, root long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding, label) to vec_id, n_links, component_id and kept, one row per input row.

    Every link is found, so any ``recall`` that is asked for is met.
    """
    rows = embeddings.select("vec_id", "embedding", "label").withColumn("__ok", _valid())
    width = F.size("embedding").alias("width")
    classes = rows.filter("__ok").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "label", "embedding", "n", "least", width))
    found = None
    for w in sorted(r.width for r in classes.select("width").distinct().collect()):  # one index per length of vector
        own = classes.filter(F.col("width") == w).drop("width")
        index = fit(own)
        part = links(own, index, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "node long, n_links long, root long")
    found = materialize(found)
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = roots.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = (
        classes.join(counts, "node", "left").join(roots.join(least, "root").select("node", "component_id"), "node", "left")
        .select("label", "embedding", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    linked = rows.filter("__ok").join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("__ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e, vec_id is not null and label is not null and coalesce(len(embedding), 0) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
pairs as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id < b.vec_id
  where a.ok and b.ok and list_cosine_similarity(a.e, b.e) >= 0.93),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by 1)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from v join least on a = vec_id
"""
