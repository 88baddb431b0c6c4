"""Splitting off bad rows, classifying them and deciding what becomes of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the detail that tells a reason's cases apart, and the code of each case
CODES = {
    "pii_detected": (
        "kind",
        {"email": "PII_EMAIL", "phone": "PII_PHONE", "ssn": "PII_SSN", "creditcard": "PII_CREDITCARD", "credit_card": "PII_CREDITCARD", "cc": "PII_CREDITCARD"},
    ),
    "schema_violation": (
        "type",
        {"missing": "SCHEMA_MISSING_REQUIRED", "missing_required": "SCHEMA_MISSING_REQUIRED", "type": "SCHEMA_TYPE_MISMATCH", "type_mismatch": "SCHEMA_TYPE_MISMATCH"},
    ),
    "outlier_detected": ("method", {"zscore": "OUTLIER_ZSCORE", "zs": "OUTLIER_ZSCORE", "z": "OUTLIER_ZSCORE", "iqr": "OUTLIER_IQR"}),
    "parse_error": ("format", {"json": "PARSE_JSON", "csv": "PARSE_CSV"}),
    "policy_denied": (
        "policy",
        {"tenant_deny": "POLICY_TENANT_DENY", "tenant": "POLICY_TENANT_DENY", "rate_limit": "POLICY_RATE_LIMIT", "ratelimit": "POLICY_RATE_LIMIT"},
    ),
}

# fixed values: what happens to an entry, by reason
DECISIONS = {
    "pii_detected": "redact_and_release",
    "schema_violation": "manual_review",
    "outlier_detected": "manual_review",
    "parse_error": "drop",
    "policy_denied": "requeue",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def split(df: DataFrame, violations: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows of a frame whose ``violations`` array was computed.

    Write both from a persisted or written frame when computing the violations is costly.
    """
    bad = F.size(violations) > 0
    return df.where(~bad).drop(violations), df.where(bad)


def classify(reason: Column, details: Column) -> Column:
    """Stable code of a reason and its details map; ``UNKNOWN`` where the details say nothing."""
    r = F.lower(F.trim(reason))
    code = F.lit("UNKNOWN")
    for name, (field, cases) in CODES.items():
        code = F.when(r == name, F.coalesce(_lookup(cases, F.lower(F.trim(details[field]))), F.lit("UNKNOWN"))).otherwise(code)
    return code


def decide(df: DataFrame, reason: str = "reason", details: str = "details") -> DataFrame:
    """Add ``decision`` and stamp it on the details map."""
    r = F.lower(F.trim(reason))
    action = F.coalesce(_lookup(DECISIONS, r), F.lit("manual_review"))
    why = F.when(F.coalesce(r.isin(*DECISIONS), F.lit(False)), r).otherwise(F.lit("default"))
    stamp = F.create_map(F.lit("recovery.action"), action, F.lit("recovery.reason"), why)
    own = F.coalesce(F.col(details), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, _: ~k.isin("recovery.action", "recovery.reason"))
    return df.withColumn("decision", action).withColumn(details, F.map_concat(kept, stamp))


def recent(df: DataFrame, tenant: str, ts: str, tie: str, limit: int = 1000) -> DataFrame:
    """The newest entries per tenant. The limit is pushed below the shuffle by Spark's group limit."""
    w = Window.partitionBy(tenant).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)


def reprocess(
    entries: DataFrame, process: Callable[[DataFrame], DataFrame], decisions: Sequence[str] = ("requeue", "redact_and_release")
) -> DataFrame:
    """Run ``process`` again over the entries with one of the given decisions."""
    return process(entries.where(F.col("decision").isin(*decisions)))
