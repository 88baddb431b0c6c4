"""Series preparation: cleaning, buckets, rolling features and resampling.

A series frame has key columns, ``ts`` and ``value``. Operators that need row order take a frame
numbered by ``positioned`` (adds ``idx``), so one range shuffle can serve several of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_small

from .positions import BLOCK_ROWS, block_window, own_rows, with_halo, with_position

TS = "timestamp_ntz"


def finite(col):
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def clean_series(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", min_points: int = 3) -> DataFrame:
    """Parse times, drop bad rows, average duplicate timestamps; series under ``min_points`` are left out."""
    keys = list(keys)
    stamp = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        stamp = F.try_to_timestamp(F.trim(stamp)).cast(TS)
    points = (
        df.select(*keys, stamp.alias("ts"), F.col(value).cast("double").alias("value"))
        .where(F.col("ts").isNotNull() & finite(F.col("value")))
        .groupBy(*keys, "ts")
        .agg(F.avg("value").alias("value"))
    )
    floor = max(3, min_points)
    enough = points.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= floor).select(*keys)
    return join_small(points, enough, keys, "left_semi")


def short_series(df: DataFrame, keys: Sequence[str], ts: str = "ts", min_points: int = 3) -> DataFrame:
    """The series ``clean_series`` leaves out, with their point count and the reason."""
    n = F.count_distinct(F.col(ts))
    return (
        df.groupBy(*keys)
        .agg(n.alias("points"))
        .where(F.col("points") < max(3, min_points))
        .withColumn("reason", F.lit("insufficient valid points"))
    )


def positioned(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the points of a cleaned series in time order."""
    return with_position(points, keys, ["ts"])


def align_down(ts, seconds: int):
    """Floor a timestamp to a whole number of ``seconds`` since the epoch."""
    unix = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(unix - F.pmod(unix, F.lit(seconds))).cast(TS)


def time_bucket_mean(df: DataFrame, keys: Sequence[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean and row count per key and time bucket."""
    return df.groupBy(*keys, align_down(F.col(ts), seconds).alias("bucket")).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n")
    )


def rolling(indexed: DataFrame, keys: Sequence[str], window: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trailing mean and population deviation over ``window`` rows, the current one included."""
    haloed = with_halo(indexed, before=window - 1, block_rows=block_rows)
    frame = block_window(keys).rowsBetween(-(window - 1), 0)
    return own_rows(
        haloed.withColumn("rolling_mean", F.avg("value").over(frame)).withColumn(
            "rolling_std", F.stddev_pop("value").over(frame)
        )
    )


def difference(indexed: DataFrame, keys: Sequence[str], lag: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Value minus the value ``lag`` rows earlier; the first ``lag`` rows get 0."""
    haloed = with_halo(indexed, before=lag, block_rows=block_rows)
    earlier = F.lag("value", lag).over(block_window(keys))
    return own_rows(haloed.withColumn("diff", F.coalesce(F.col("value") - earlier, F.lit(0.0))))


def resample(points: DataFrame, keys: Sequence[str], seconds: int, method: str = "last", block_rows: int = 1 << 16) -> DataFrame:
    """Regular grid from the first to the last bucket of each series.

    ``last`` and ``mean`` carry the previous bucket forward. ``linear`` draws a line between the
    neighbouring filled buckets, each represented by its last value. The grid is generated gap by
    gap from the filled buckets, so only neighbouring buckets are ever compared and no task holds
    a whole series.
    """
    if method not in ("last", "mean", "linear"):
        raise ValueError("unknown resample method")
    keys = list(keys)
    agg = F.avg("value") if method == "mean" else F.max_by("value", "ts")
    buckets = points.groupBy(*keys, align_down(F.col("ts"), seconds).alias("ts")).agg(agg.alias("value"))
    indexed = positioned(buckets, keys)
    haloed = with_halo(indexed, after=1, block_rows=block_rows)
    w = block_window(keys)
    gaps = own_rows(
        haloed.withColumn("__next_ts", F.lead("ts").over(w)).withColumn("__next", F.lead("value").over(w))
    )
    unix = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    steps = F.coalesce((unix("__next_ts") - unix("ts")) / F.lit(seconds), F.lit(1)).cast("bigint")
    run = F.lit(4096).cast("bigint")
    # two explodes keep the array of even a very long gap short
    grid = (
        gaps.withColumn("__steps", steps)
        .withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__steps") - 1) / run))))
        .withColumn(
            "__k",
            F.explode(
                F.sequence(F.col("__run") * run, F.least(F.col("__run") * run + run, F.col("__steps")) - 1)
            ),
        )
    )
    value = F.col("value")
    if method == "linear":
        share = F.col("__k").cast("double") / F.col("__steps").cast("double")
        value = F.when(F.col("__k") == 0, value).otherwise(value + share * (F.col("__next") - value))
    return grid.select(
        *keys,
        F.timestamp_seconds(unix("ts") + F.col("__k") * F.lit(seconds)).cast(TS).alias("ts"),
        value.alias("value"),
        (F.col("__k") > 0).alias("filled"),
    )
