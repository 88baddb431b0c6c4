"""Joins of record sets: first match, many inputs, rules, watch lists, as-of."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, on_same
from .dedupe import first_per_key
from .positions import BLOCK_ROWS, with_position


def join_first_match(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, order_a: Sequence[str]) -> DataFrame:
    """All rows of ``b`` with the first row of ``a`` that has the same key, compared as text.

    ``a`` is reduced to one row per key before the join, so a hot key of ``a`` cannot multiply rows.
    """
    left = first_per_key(a.withColumn("join_value", key_a.cast("string")), ["join_value"], order_a)
    right = b.withColumn("join_value", key_b.cast("string")).where(F.col("join_value").isNotNull())
    return left.join(right, "join_value")


def join_multi_full(inputs: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str], order: str) -> DataFrame:
    """One row per key tuple with a column ``input:measure`` per input; missing measures are NULL.

    Where an input has several rows per key the newest by ``order`` wins. A single shuffle groups
    the union of all inputs; keys with a NULL part are left out.
    """
    keys = list(keys)
    wide = None
    columns = [(name, m) for name, (_, ms) in inputs.items() for m in ms]
    for name, (df, measures) in inputs.items():
        own = [
            (F.col(m).cast("double") if n == name else F.lit(None).cast("double")).alias(f"{n}:{m}") for n, m in columns
        ]
        part = df.dropna(subset=keys).select(*keys, F.col(order).alias("__o"), F.lit(name).alias("__in"), *own)
        wide = part if wide is None else wide.unionByName(part)
    latest = [
        F.max_by(F.col(f"`{n}:{m}`"), F.when(F.col("__in") == n, F.col("__o"))).alias(f"{n}:{m}") for n, m in columns
    ]
    return wide.groupBy(*keys).agg(*latest)


@dataclass(frozen=True)
class ControlRule:
    """Controls of the actions that contain ``part``; with ``outcomes`` only of those that ended so."""

    part: str
    controls: Sequence[str]
    outcomes: Sequence[str] = ()
    enabled: bool = True


def rules_join(df: DataFrame, action: str, rules: Sequence[ControlRule | tuple[str, Sequence[str]]], fallback: str = "unknown", outcome: str | None = None) -> DataFrame:
    """Sorted set of the controls whose rule matches the action (and outcome); ``fallback`` if none does.

    The rules are a fixed handful, so they become one expression per row and nothing is joined.
    """
    rules = [rule if isinstance(rule, ControlRule) else ControlRule(*rule) for rule in rules]
    if outcome is None and any(rule.enabled and rule.outcomes for rule in rules):
        raise ValueError("rules with outcomes need the outcome column")
    ended = F.lower(F.trim(outcome)) if outcome else None
    applies = lambda rule: F.lit(True) if not rule.outcomes else F.coalesce(ended.isin(*[o.lower() for o in rule.outcomes]), F.lit(False))
    low = F.lower(F.trim(F.regexp_replace(action, r"\s+", " ")))
    hits = F.flatten(
        F.array(
            *[
                F.when(low.contains(rule.part) & applies(rule), F.array(*map(F.lit, rule.controls))).otherwise(F.array().cast("array<string>"))
                for rule in rules
                if rule.enabled
            ]
        )
    )
    found = F.sort_array(F.array_distinct(hits))
    return df.withColumn("controls", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback))))


def watchlist(df: DataFrame, symbol: str, listed: DataFrame) -> DataFrame:
    """Rows whose symbol is on the list; an empty list keeps everything."""
    names = listed.select(F.upper(F.trim(listed.columns[0])).alias("__sym")).where("__sym <> ''").distinct()
    if names.limit(1).count() == 0:
        return df
    return df.join(names, F.upper(F.trim(symbol)) == F.col("__sym"), "left_semi")


def anti_seen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not seen before."""
    return df.join(seen.select(*keys), list(keys), "left_anti")


def join_asof(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each left row the newest right ``value`` at or before its time, per entity.

    Both sides are numbered together in time order. Inside a block the last known value is a
    window; across blocks only the last value of each block travels.
    """
    by = list(by)
    cols = [c for c in left.columns if c not in (*by, ts)]
    a = left.select(*by, ts, F.lit(1).alias("__side"), F.struct(*cols).alias("__row"), F.lit(None).cast("double").alias("__v"))
    empty = F.lit(None).cast(a.schema["__row"].dataType)
    b = right.select(*by, ts, F.lit(0).alias("__side"), empty.alias("__row"), F.col(value).cast("double").alias("__v"))
    placed = with_position(a.unionByName(b), by, [ts, "__side", "__row", "__v"])
    blocked = placed.withColumn("__blk", F.floor(F.col("idx") / F.lit(block_rows)).cast("bigint"))
    ends = blocked.where("__side = 0").groupBy(*by, "__blk").agg(F.max_by("__v", "idx").alias("__carry"))
    # pass the last value of each block on to the next ones: one row per block
    blocks = on_same(blocked.select(*by, "__blk").distinct(), ends, [*by, "__blk"], "left")
    w = Window.partitionBy(*by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*by, "__blk", F.last("__carry", ignorenulls=True).over(w).alias("__before"))
    inside = Window.partitionBy(*by, "__blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    known = blocked.withColumn("__inside", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    out = join_small(known, carried, [*by, "__blk"]).withColumn(value, F.coalesce("__inside", "__before"))
    return out.select(*by, ts, "__row.*", value)

