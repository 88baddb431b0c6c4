"""Downsampling for charts: largest-triangle buckets and a fixed stride."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_small, on_same

from .anomaly import counts

PIECE = 8192


def _bucketed(indexed: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    """Bucket number of every row: ends are alone in bucket -1 and ``points - 2``."""
    n = F.col("n_points")
    every = (n - 2).cast("double") / F.lit(float(points - 2))
    sized = join_small(indexed, counts(indexed, keys), list(keys))
    guess = F.floor((F.col("idx") - 1) / every)
    edge = lambda b: F.floor(b * every) + 1
    # the guess can be one off through rounding of the bucket edges
    inner = (
        F.when(F.col("idx") < edge(guess), guess - 1).when(F.col("idx") >= edge(guess + 1), guess + 1).otherwise(guess)
    )
    bucket = F.when(F.col("idx") == 0, -1).when(F.col("idx") == n - 1, points - 2).otherwise(inner)
    return sized.withColumn("bucket", bucket.cast("bigint"))


def _hull(idx, x, y):
    """Positions on the convex hull of points sorted by x (Andrew's monotone chain)."""
    keep: set[int] = set()
    order = range(len(idx))
    for sign in (1.0, -1.0):
        chain: list[int] = []
        for p in order:
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                turn = (x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a])
                if sign * turn > 0:
                    break
                chain.pop()
            chain.append(p)
        keep.update(chain)
    return sorted(keep)


def lttb(indexed: DataFrame, keys: Sequence[str], points: int, piece: int = PIECE) -> DataFrame:
    """Largest-triangle-three-buckets: keep ``points`` rows per series, both ends among them.

    Each pick maximises the triangle with the previous pick and the next bucket's mean. The area is
    the absolute value of a linear function of the candidate, so only rows on the convex hull of a
    bucket can win. Pieces of a bucket are reduced to their hulls in parallel; the sequential walk
    then reads ``points`` buckets of a few hull rows per series, however long the series is.
    """
    keys = list(keys)
    if points < 3:
        ends = join_small(indexed, counts(indexed, keys), keys)
        return ends.where((F.col("idx") == 0) | (F.col("idx") == F.col("n_points") - 1)).select(
            *keys, "idx", "ts", "value"
        )
    sized = counts(indexed, keys)
    short = join_small(indexed, sized.where(F.col("n_points") <= points), keys).select(*keys, "idx", "ts", "value")
    rows = _bucketed(join_small(indexed, sized.where(F.col("n_points") > points).select(*keys), keys, "left_semi"), keys, points)
    rows = rows.withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    means = rows.where("bucket >= 0").groupBy(*keys, (F.col("bucket") - 1).alias("bucket")).agg(
        F.avg("x").alias("cx"), F.avg("value").alias("cy")
    )

    def reduce_hull(frame: DataFrame, group: list[str]) -> DataFrame:
        fields = F.sort_array(F.collect_list(F.struct("idx", "x", "value", "ts")))
        packed = frame.groupBy(*group).agg(fields.alias("p"))

        def pick(idx: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([_hull(i, a, b) for i, a, b in zip(idx, x, y, strict=True)])

        on_hull = F.pandas_udf(pick, "array<int>")("p.idx", "p.x", "p.value")
        kept = packed.withColumn("__k", on_hull)
        return kept.select(*group, F.explode(F.transform("__k", lambda i: F.get(F.col("p"), i))).alias("r")).select(
            *group, "r.*"
        )

    widest = sized.agg(F.max("n_points")).first()[0] or 0
    hulls, span = rows.select(*keys, "bucket", "idx", "x", "value", "ts"), piece
    while True:
        # pieces grow with every level, so the rows collected together stay few
        group = [*keys, "bucket", "__piece"]
        hulls = reduce_hull(hulls.withColumn("__piece", F.floor(F.col("idx") / span)), group).drop("__piece")
        if span * (points - 2) >= widest:
            break
        span *= 64
    hulls = on_same(reduce_hull(hulls, [*keys, "bucket"]), means, [*keys, "bucket"], "left")
    ddl = ", ".join(f"`{k}` {dict(indexed.dtypes)[k]}" for k in keys)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        picks, ax, ay = [], None, None
        for bucket, cand in pdf.groupby("bucket", sort=True):
            if bucket < 0 or bucket == points - 2:
                best = cand.iloc[-1]
            else:
                area = ((ax - cand["cx"]) * (cand["value"] - ay) - (ax - cand["x"]) * (cand["cy"] - ay)).abs()
                best = cand.loc[area.idxmax()]
            ax, ay = best["x"], best["value"]
            picks.append(best)
        return pd.DataFrame(picks)[[*keys, "idx"]].astype({"idx": "int64"})

    picked = hulls.drop("ts").groupBy(*keys).applyInPandas(walk, f"{ddl}, idx bigint")
    return short.unionByName(on_same(indexed, picked, [*keys, "idx"], "left_semi").select(*keys, "idx", "ts", "value"))


def stride_sample(indexed: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    """``points`` evenly spaced rows, ends kept, computed from the row number alone."""
    need = max(points - 2, 0)
    sized = join_small(indexed, counts(indexed, keys), list(keys))
    n, i = F.col("n_points"), F.col("idx")
    step = (n - 2).cast("double") / F.lit(float(need + 1))
    nth = F.ceil((i - 1) / step)
    hit = lambda k: (k >= 1) & (k <= need) & (F.least(F.floor(k * step) + 1, n - 2) == i)
    inner = hit(nth) | hit(nth + 1) | hit(nth - 1)
    return sized.where((n <= points) | (i == 0) | (i == n - 1) | inner).select(*keys, "idx", "ts", "value")
