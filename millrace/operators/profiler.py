"""Schema profiling: field lists, mapping guesses, scores, join keys, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_of, safe_token
from .documents import flatten_paths

# fixed values: strength of the types; the strongest seen names the field
TYPE_RANK = {"number": 4, "string": 3, "boolean": 2, "array": 1, "null": 0}


def infer_fields(df: DataFrame, doc: str, order: Sequence[str]) -> DataFrame:
    """Path, label, strongest type, first sample and row count of every field.

    Positions in arrays are read as ``[0]``; elements of plain arrays have type ``array``. All
    documents are read, and a partial aggregation keeps one row per path and task. The set of at most five types per path
    also makes the planner aggregate by hash: with texts alone it sorts all leaves of a task first.
    """
    leaves = flatten_paths(df, order, doc)
    in_array = F.col("path").rlike(r"\[\d+\]$")
    kind = F.when(in_array, F.lit("array")).otherwise(F.col("type"))
    rank = F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[kind]
    rows = leaves.select(
        F.regexp_replace("path", r"\[\d+\]", "[0]").alias("path"),
        rank.alias("rank"),
        "value",
        F.struct(*order, F.col("path").alias("p")).alias("__o"),
    )
    fields = rows.groupBy("path").agg(
        F.array_max(F.collect_set("rank")).alias("rank"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("__o"))).alias("sample"),
        F.count("value").alias("filled"),
    )
    names = F.create_map(*[F.lit(x) for kind, rank in TYPE_RANK.items() for x in (rank, kind)])
    return fields.select("path", F.try_element_at(names, F.col("rank")).alias("type"), "sample", "filled", label_of(F.col("path")).alias("label"))


def auto_map(fields: DataFrame) -> DataFrame:
    """Guess where each field goes: a time dimension, a measure or another dimension."""
    steps = F.split(F.regexp_replace(F.regexp_replace("path", r"\[", "."), r"\]", ""), r"\.")
    tokens = F.filter(F.transform(steps, lambda s: safe_token(F.trim(s))), lambda s: s != "")
    path = F.array_join(tokens, ".")
    numeric = (F.col("type") == "number") | F.trim("sample").try_cast("double").isNotNull()
    timely = path.contains("date") | path.contains("timestamp") | path.contains("occurred")
    target = (
        F.when(path.contains("year") & numeric, F.lit("dims.time.year"))
        .when(timely, F.lit("dims.time.occurred_at"))
        .when(numeric, F.concat(F.lit("measures."), path))
        .otherwise(F.concat(F.lit("dims."), path))
    )
    return fields.where(path != "").withColumn("target", target)


# fixed values: name parts that speak for a role
TIME_PARTS = ("year", "date", "time", "timestamp")
JOIN_PARTS = ("id", "code", "cik", "fips", "state", "series")
METRIC_PARTS = ("rate", "count", "total", "amount", "value")
GEO_PARTS = ("state", "fips", "lat", "lon", "zip", "county", "census")
GEO_STRONG = ("state", "fips", "county", "census")


def _any(text: Column, parts: Sequence[str]) -> Column:
    return text.rlike("|".join(parts))


def score_fields(fields: DataFrame) -> DataFrame:
    """Scores of every field as time, join key, metric and place, one row per role it could have."""
    text = F.lower(F.concat("path", F.lit(" "), "label"))
    number, string = F.col("type") == "number", F.col("type") == "string"
    year = F.coalesce(F.col("sample").try_cast("double").between(1900, 2100), F.lit(False))
    points = lambda test, n: F.when(test, n).otherwise(0)
    time = points(_any(text, TIME_PARTS), 3) + points(number & year, 2)
    time = time + points(string & _any(text, ("timestamp", "date", "time")), 2)
    roles = {
        "time": time,
        "join": F.when(string, 1 + points(_any(text, JOIN_PARTS), 2)).otherwise(0),
        "metric": F.when(number, 1 + points(_any(text, METRIC_PARTS), 2)).otherwise(0),
        "geo": F.when(_any(text, GEO_PARTS), 1 + points(_any(text, GEO_STRONG), 2)).otherwise(0),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("role"), c.cast("bigint").alias("score")) for n, c in roles.items()])
    scored = fields.select("path", "label", "type", F.explode(cells).alias("c")).select("path", "label", "type", "c.*")
    w = Window.partitionBy("role").orderBy(F.desc("score"), "path")
    # one row per field and role reaches this window
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w).cast("bigint"))


# fixed values: name parts that speak for a shared key
KEY_PARTS = ("id", "code", "symbol", "name", "state", "country", "zip")


def suggest_join_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns both datasets have under the same label, scored by name and by shared values.

    The candidates come from the schemas; the values of all of them are compared in one shuffle
    that counts distinct keys on either side and on both.
    """
    tidy = lambda c: " ".join(c.replace("_", " ").replace("-", " ").lower().split())
    names_b = {tidy(c): c for c in b.columns}
    pairs = [(tidy(c), c, names_b[tidy(c)]) for c in a.columns if tidy(c) in names_b]
    if not pairs:
        return a.sparkSession.createDataFrame([], "label string, score bigint, keys_a bigint, keys_b bigint, shared bigint, overlap double")

    def keys(df: DataFrame, pick: int, side: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(p[0]).alias("label"), F.col(p[pick]).cast("string").alias("k")) for p in pairs])
        rows = df.select(F.explode(cells).alias("c")).select("c.*").where("k is not null")
        return rows.withColumn("in_a", F.lit(side == 0)).withColumn("in_b", F.lit(side == 1))

    both = keys(a, 1, 0).unionByName(keys(b, 2, 1)).groupBy("label", "k").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    counted = both.groupBy("label").agg(
        F.count_if("in_a").alias("keys_a"),
        F.count_if("in_b").alias("keys_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"),
    )
    score = sum((F.when(F.col("label").contains(p), 2).otherwise(0) for p in KEY_PARTS), F.lit(1))
    overlap = F.col("shared") / F.greatest(F.least("keys_a", "keys_b"), F.lit(1))
    return counted.select("label", score.cast("bigint").alias("score"), "keys_a", "keys_b", "shared", overlap.alias("overlap"))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed, retyped and re-optioned fields between two (path, type, optional) lists."""
    tidy = lambda df, s: df.where(F.trim("path") != "").select(
        F.trim("path").alias("path"), F.lower(F.trim("type")).alias(f"{s}_type"), F.col("optional").alias(f"{s}_opt")
    )
    j = tidy(old, "old").join(tidy(new, "new"), "path", "full_outer")
    gone, fresh = F.col("new_type").isNull(), F.col("old_type").isNull()
    event = lambda test, kind, a, b: F.when(test, F.struct(F.lit(kind).alias("drift"), a.alias("from"), b.alias("to")))
    blank = F.lit("")
    events = F.array_compact(
        F.array(
            event(gone, "removed", F.col("old_type"), blank),
            event(fresh, "added", blank, F.col("new_type")),
            event(~gone & ~fresh & (F.col("old_type") != F.col("new_type")), "type_changed", F.col("old_type"), F.col("new_type")),
            event(
                ~gone & ~fresh & (F.col("old_opt") != F.col("new_opt")),
                "optional_changed",
                F.col("old_opt").cast("string"),
                F.col("new_opt").cast("string"),
            ),
        )
    )
    return j.select("path", F.explode(events).alias("e")).select("path", "e.*")
