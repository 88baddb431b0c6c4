"""Grouped statistics, correlation and telemetry roll-ups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize, on_same, with_scalar
from .positions import with_position, with_running


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, sum, extremes, mean and population deviation per non-blank group."""
    v = F.expr(f"try_cast(`{value}` as double)")
    rows = df.select(F.trim(group).alias("group"), v.alias("v")).where((F.col("group") != "") & F.col("v").isNotNull())
    return rows.where(~F.isnan("v")).groupBy("group").agg(
        F.count("*").alias("count"),
        F.sum("v").alias("sum"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("stddev"),
    )


def _through(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values ``v`` per key with their count ``c`` and the rows up to and with them, ``through``.

    Equal values combine before the shuffle and are one row afterwards, so neither a hot key nor a
    hot value fills one task; the running counts go over blocks.
    """
    counted = df.select(*keys, F.col(value).alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("c"))
    return with_running(with_position(counted, keys, ["v"]), keys, {"through": F.col("c")}).drop("idx")


def _covers(at: Column) -> Column:
    """Is the row at this position one of the rows with this value?"""
    return (F.col("through") - F.col("c") <= at) & (at < F.col("through"))


def percentile_nearest(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """Nearest-rank percentiles, ``percents`` clamped to 0..100."""
    keys = list(keys)
    values = materialize(_through(df, keys, value))
    sizes = values.groupBy(*keys).agg(F.sum("c").alias("n"))
    wanted = [(p, min(max(p, 0.0), 100.0) / 100.0) for p in percents]
    spots = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.greatest(F.ceil(F.lit(q) * F.col("n")) - 1, F.lit(0)).cast("bigint").alias("at"),
            )
            for p, q in wanted
        ]
    )
    picked = join_small(values, sizes.select(*keys, spots.alias("spots")), keys)
    hits = picked.select(*keys, "v", F.explode(F.filter("spots", lambda s: _covers(s["at"]))).alias("s"))
    return hits.select(*keys, F.col("s.p").alias("percent"), F.col("v").alias("percentile"))


def dist_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes, median and Tukey quartiles (medians of the two halves).

    The middle positions of the whole and of both halves are looked up in the running counts of the
    distinct values: no group is ever gathered into an array.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("v")).where("v is not null")
    plain = materialize(
        rows.groupBy(*keys).agg(
            F.count("*").alias("count"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.min("v").alias("min"), F.max("v").alias("max")
        )
    )
    n = F.col("count")
    half = F.floor(n / 2)

    def middle(skip: Column, size: Column) -> Column:
        at = [skip + F.floor((size - 1) / 2), skip + F.floor(size / 2)]
        return sum(F.sum(F.when(_covers(p), F.col("v"))) for p in at) / 2

    single = n == 1
    placed = on_same(_through(df, keys, value), plain.select(*keys, "count"), keys)
    middles = placed.groupBy(*keys).agg(
        middle(F.lit(0), n).alias("median"),
        middle(F.lit(0), F.when(~single, half)).alias("q1"),
        middle(n - half, F.when(~single, half)).alias("q3"),
    )
    out = on_same(plain, middles, keys)
    return out.withColumns({q: F.coalesce(q, "min") for q in ("q1", "q3")})


def outliers_z(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose z-score against their whole group reaches the threshold."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = (F.col(value) - F.col("__m")) / F.col("__s")
    hit = join_small(df, stats, list(keys)).where(F.col("__s") > 0).withColumn("score", F.abs(z))
    return hit.where(F.col("score") >= threshold).drop("__m", "__s")


def outliers_iqr(df: DataFrame, keys: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows outside the Tukey fences of their group."""
    stats = dist_stats(df, keys, value).select(*keys, F.col("q1").alias("__q1"), F.col("q3").alias("__q3"))
    spread = F.col("__q3") - F.col("__q1")
    low, high = F.col("__q1") - k * spread, F.col("__q3") + k * spread
    hit = join_small(df, stats, list(keys)).where((F.col(value) < low) | (F.col(value) > high))
    return hit.withColumn("side", F.when(F.col(value) < low, "low").otherwise("high")).drop("__q1", "__q3")


# --- correlation ------------------------------------------------------------------------------


def safe_corr(a: str, b: str) -> Column:
    """Pearson r over the pairs without NULL; 0 where it is undefined (``corr`` would fail there)."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


def pearson(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pair count and Pearson r; r is 0 for fewer than two pairs or without variance."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.where(both).groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(a, b).alias("r"))


def with_pvalue(stats: DataFrame) -> DataFrame:
    """Two-sided p-value of ``r`` over ``n`` pairs by the normal approximation; 1 below three pairs."""

    def tail(t: pd.Series) -> pd.Series:
        return t.map(lambda x: min(1.0, max(0.0, 1.0 - math.erf(x / math.sqrt(2.0)))))

    room = 1 - F.col("r") * F.col("r")
    t = F.when(room > 0, F.abs("r") * F.sqrt((F.col("n") - 2) / room)).otherwise(F.lit(1e9))
    p = F.when(F.col("n") < 3, F.lit(1.0)).otherwise(F.pandas_udf(tail, "double")(F.greatest(t, F.lit(0.0))))
    return stats.withColumn("p_value", p)


def corr_label(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a >= 0.8, "Strong correlation")
        .when(a >= 0.6, "Moderate correlation")
        .when(a >= 0.4, "Weak correlation")
        .otherwise("Very weak correlation")
    )


def corr_matrix(df: DataFrame, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r of every pair of measures in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i + 1 :]]
    wide = df.groupBy(*keys).agg(
        *[safe_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
    )
    cells = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"),
            F.col(f"r{i}").alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


# --- counts and roll-ups ----------------------------------------------------------------------


def results_summary(df: DataFrame, profile: str, drone: str) -> DataFrame:
    """Total rows, distinct senders and rows by profile, from one grouping-set pass."""
    per = df.groupBy(profile, drone).agg(F.count("*").alias("n"))
    total = per.agg(
        F.lit("total").alias("kind"), F.lit("").alias("name"), F.sum("n").alias("rows"), F.count_distinct(drone).alias("drones")
    )
    by = per.groupBy(F.lit("profile").alias("kind"), F.col(profile).alias("name")).agg(
        F.sum("n").alias("rows"), F.count_distinct(drone).alias("drones")
    )
    return total.unionByName(by)


def status_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def log_summary(df: DataFrame, id_columns: Sequence[str], ts: str, since: Column, dims: Sequence[str], top: int) -> DataFrame:
    """Counts by each dimension since a time after removing repeats; largest first, ``top`` per dimension."""
    fresh = df.where(F.col(ts) >= since).dropDuplicates(list(id_columns))
    rows = fresh.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("name")) for d in dims])).alias("d")
    )
    counted = rows.groupBy("d.dim", "d.name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "name")
    return counted.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def heartbeat_stats(beats: DataFrame, key: str, ts: str, now: Column, window_seconds: int) -> DataFrame:
    """Total, active and offline senders by the age of their newest heartbeat."""
    newest = beats.groupBy(key).agg(F.max(ts).alias("seen"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp"))
    off = age > window_seconds * 1_000_000
    return newest.agg(
        F.count("*").alias("total"), F.count_if(~off).alias("active"), F.count_if(off).alias("offline")
    )


# fixed values: health states by severity
SEVERITY = {"fatal": 4, "degraded": 3, "ok": 2, "unknown": 1}


def health_rollup(df: DataFrame, keys: Sequence[str], name: str, status: str) -> DataFrame:
    """Worst state per component name (case-insensitive), then the worst of all as ``overall``."""
    state = F.lower(F.trim(status))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[state], F.lit(1))
    component = F.lower(F.trim(name))
    worst = df.where(component != "").groupBy(*keys, component.alias("component")).agg(F.max(rank).alias("rank"))
    back = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)])
    return worst.groupBy(*keys).agg(
        F.count("*").alias("components"),
        F.count_if(F.col("rank") == 4).alias("fatal"),
        F.count_if(F.col("rank") == 3).alias("degraded"),
        back[F.max("rank")].alias("overall"),
    )


def label_key(labels: Column) -> Column:
    """``name=value`` pairs of a label map sorted by name, for display."""
    pairs = F.sort_array(F.map_entries(labels))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _by_labels(df: DataFrame, labels: Column, total: Column) -> DataFrame:
    """``total`` per label set. Sets are compared as sorted pairs and written out afterwards, so their texts can't collide."""
    grouped = df.groupBy(F.sort_array(F.map_entries(labels)).alias("__set")).agg(total)
    return grouped.withColumn("labels", label_key(F.map_from_entries("__set"))).drop("__set")


def counter_sum(df: DataFrame, labels: Column, value: str) -> DataFrame:
    """Sum of the positive increments per label set."""
    return _by_labels(df.where(F.col(value) > 0), labels, F.sum(value).alias("total"))


def gauge_last(df: DataFrame, labels: Column, value: str, order: Sequence[str]) -> DataFrame:
    """Value of the newest row per label set."""
    return _by_labels(df, labels, F.max_by(value, F.struct(*order)).alias("last"))


def histogram_cumulative(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Rows at or below each bound, the last bound open; one pass, no explode of the input."""
    cells = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*cells, F.count(value).alias("ball"))
    le = [
        F.struct(F.lit(str(float(b))).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("ball").alias("count"))]
    return wide.select(*keys, F.explode(F.array(*le)).alias("b")).select(*keys, "b.le", "b.count")


def index_projection(df: DataFrame, symbol: str, suffix: str, volume: str, min_volume: float, means: Sequence[str], sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the price columns and sum of the volumes over the symbols with the suffix."""
    member = df.where(F.col(symbol).endswith(suffix) & (F.col(volume) >= min_volume))
    return member.groupBy(*keys).agg(
        F.count("*").alias("constituents"),
        *[F.avg(c).alias(c) for c in means],
        *[F.sum(c).alias(c) for c in sums],
    )


def top_weighted_index(df: DataFrame, symbol: str, suffix: str, weight: str, price: str, k: int = 10) -> DataFrame:
    """Mean price of the ``k`` symbols with the highest weight."""
    ok = df.where(F.col(symbol).endswith(suffix) & (F.col(weight) > 0) & (F.col(price) > 0))
    return ok.orderBy(F.desc(weight), symbol).limit(k).agg(F.count("*").alias("members"), F.avg(price).alias("index"))


def topk_movers(df: DataFrame, symbol: str, suffix: str, weight: str, min_weight: float, change: str, k: int, direction: str) -> DataFrame:
    """Largest rises (or falls) among the symbols with enough weight."""
    ok = df.where(F.col(symbol).endswith(suffix) & (F.col(weight) >= min_weight))
    first = F.asc(change) if direction == "losers" else F.desc(change)
    return ok.orderBy(first, symbol).limit(k)


def run_rollup(runs: DataFrame, profile: str) -> DataFrame:
    """Runs, rows, failures and the 95th percentile duration per profile."""
    base = runs.groupBy(profile).agg(
        F.count("*").alias("runs"),
        F.sum("rows_out").alias("rows_out"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.avg("duration_ms").alias("mean_ms"),
    )
    p95 = percentile_nearest(runs, [profile], "duration_ms", [95]).select(profile, F.col("percentile").alias("p95_ms"))
    return on_same(base, p95, [profile], "left")


def heat_grid(df: DataFrame, x: str, y: str, value: str, order: Sequence[str], max_x: int | None = None, max_y: int | None = None) -> DataFrame:
    """Last value per cell, with the scale over all cells.

    For drawing, ``max_x`` and ``max_y`` keep the first sorted values of an axis; without them every cell is returned.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()).withColumnsRenamed({x: "x", y: "y"})
    grid = cells.groupBy("x", "y").agg(F.max_by(value, F.struct(*order)).alias("value"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    for axis, most in (("x", max_x), ("y", max_y)):
        if most is not None:
            grid = join_small(grid, grid.select(axis).distinct().orderBy(axis).limit(most), [axis], "left_semi")
    scale = grid.agg(F.min("__lo").alias("min"), F.max("__hi").alias("max"))
    return with_scalar(grid.drop("__lo", "__hi"), scale)
