"""Label sets and trace spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_token

# fixed values: lengths that a label set should not exceed, and the form of a name
MAX_PAIRS, MAX_NAME, MAX_VALUE = 32, 64, 256
NAME = r"^[a-z_][a-z0-9_.\-]*$"


def _tidy(labels: Column) -> Column:
    return F.transform(
        F.sort_array(F.map_entries(labels)), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value"))
    )


def normalize_labels(labels: Column) -> Column:
    """Lower-case trimmed names and trimmed values, sorted by name.

    Blank and ill-formed names are left out; ``label_problems`` tells which. When two names become equal the
    one that sorts last wins.
    """
    good = F.filter(_tidy(labels), lambda e: e["key"].rlike(NAME))
    names = F.sort_array(F.array_distinct(F.transform(good, lambda e: e["key"])))
    last = lambda n: F.element_at(F.filter(good, lambda e: e["key"] == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def label_problems(labels: Column) -> Column:
    """What is wrong with a label set: names that are left out, and names, values and sets beyond their usual length."""
    found = F.transform(
        _tidy(labels),
        lambda e: F.when(~e["key"].rlike(NAME), F.concat(F.lit("name:"), e["key"]))
        .when(F.length(e["key"]) > MAX_NAME, F.concat(F.lit("long_name:"), e["key"]))
        .when(F.length(e["value"]) > MAX_VALUE, F.concat(F.lit("long_value:"), e["key"])),
    )
    return F.concat(F.array_compact(found), F.array_compact(F.array(F.when(F.size(labels) > MAX_PAIRS, F.lit("many_pairs")))))


def fingerprint(labels: Column) -> Column:
    """SHA-256 over the sorted names and values, each ended by NUL; empty for no labels."""
    pairs = F.sort_array(F.map_entries(labels))
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("\0"), e["value"], F.lit("\0"))), "")
    return F.when(F.size(labels) > 0, F.sha2(text, 256)).otherwise(F.lit(""))


def normalize_spans(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean spans with duration and their parent's duration, and the spans that are not usable.

    Needs trace_id, span_id, parent_id, operation, start and end.
    """
    words = ("trace_id", "span_id", "parent_id", "operation")
    tidy = spans.withColumns({c: norm_token(F.col(c)) for c in words})
    missing = F.array_compact(
        F.array(
            *[F.when(F.col(c) == "", F.lit(f"missing:{c}")) for c in ("trace_id", "span_id", "operation")],
            *[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in ("start", "end")],
            F.when(F.col("end") < F.col("start"), F.lit("end_before_start")),
        )
    )
    checked = tidy.withColumn("problems", missing)
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    good = checked.where(F.size("problems") == 0).drop("problems").withColumn("seconds", seconds)
    # a span id may repeat in a trace: the longest such span is the parent, so no row is multiplied
    parents = good.groupBy("trace_id", F.col("span_id").alias("parent_id")).agg(F.max("seconds").alias("parent_seconds"))
    return good.join(parents, ["trace_id", "parent_id"], "left"), checked.where(F.size("problems") > 0)
