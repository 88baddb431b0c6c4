"""First, newest and distinct rows; merging of stored points; set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row per key in a total order, as an aggregation with partial merging.

    ``min_by`` over the whole row combines before the shuffle, so a key with a third of all rows
    costs one row per task. Rows with a NULL key are left out.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    grouped = df.dropna(subset=keys).groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return grouped.select(*keys, "__row.*").select(*df.columns)


def rank_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key."""
    return first_per_key(df, keys, order, last=True)


def dedupe_by_path(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """First document per key value as text; rows with a blank key are dropped."""
    keyed = df.withColumn("dedupe_key", F.trim(key.cast("string"))).where(F.col("dedupe_key") != "")
    return first_per_key(keyed, ["dedupe_key"], order)


def dedupe_points(df: DataFrame, series: Sequence[str], ts: str, order: Sequence[str], keep: str = "first") -> DataFrame:
    """One point per series and timestamp, the first or last in ``order``."""
    return first_per_key(df, [*series, ts], order, last=keep == "last")


def compact_series(
    chunks: Sequence[DataFrame],
    series: Sequence[str],
    ts: str,
    start: Column,
    end: Column,
    order: Sequence[str],
    keep: str = "first",
    drop_out_of_range: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Merge chunks, keep one point per timestamp, clip to ``[start, end)``.

    Returns the points and one row per series with input, duplicate and out-of-range counts.
    """
    series = list(series)
    merged = chunks[0]
    for chunk in chunks[1:]:
        merged = merged.unionByName(chunk)
    unique = dedupe_points(merged, series, ts, order, keep)
    inside = (F.col(ts) >= start) & (F.col(ts) < end)
    points = unique.where(inside) if drop_out_of_range else unique
    per_ts = merged.groupBy(*series, ts).agg(F.count("*").alias("__n"))
    report = per_ts.groupBy(*series).agg(
        F.sum("__n").alias("input_points"),
        (F.sum("__n") - F.count("*")).alias("duplicates"),
        F.count_if(~inside).alias("outside"),
    )
    return points, report


def upsert_points(stored: DataFrame, incoming: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Stored points with the incoming ones written over them; the highest ``seq`` wins."""
    return first_per_key(stored.unionByName(incoming), key, [seq], last=True)


def import_points(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored points plus the incoming ones whose key is not stored yet."""
    return stored.unionByName(incoming.join(stored.select(*key), list(key), "left_anti"))


def union_profiles(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_labels(base: Column, extra: Column) -> Column:
    """Both maps in one; ``extra`` wins, names are lower-case and sorted."""
    tidy = lambda m: F.transform_keys(m, lambda k, v: F.lower(F.trim(k)))
    kept = F.map_filter(tidy(base), lambda k, v: ~F.map_contains_key(tidy(extra), k))
    return F.map_from_entries(F.sort_array(F.map_entries(F.map_concat(kept, tidy(extra)))))
