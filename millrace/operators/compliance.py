"""Redaction, pseudonyms, retention and control mapping of audit records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.hashing import canonical_json, hmac_sha256
from ..functions.text import norm_token

# fixed values: substring of an audit action and the control sets it belongs to
CONTROL_RULES = (
    ("access", ("access", "security")),
    ("login", ("access", "security")),
    ("role", ("access",)),
    ("permission", ("access",)),
    ("deploy", ("change_mgmt",)),
    ("change", ("change_mgmt",)),
    ("config", ("change_mgmt",)),
    ("invoice", ("financial_reporting",)),
    ("payment", ("financial_reporting",)),
    ("revenue", ("financial_reporting",)),
)

# fixed values: paths redacted unless told otherwise, and the text put in their place
REDACTED = "[REDACTED]"
REDACT_PATHS = ("detail.email", "detail.phone", "detail.ip", "detail.name", "meta.email", "meta.phone", "meta.ip")

# fixed values: days kept for personal data and for financial controls
PERSONAL_DAYS = 90
CONTROL_DAYS = 7 * 365


def _mask_entry(entries: Column, name: str, replacement: str) -> Column:
    return F.transform_values(entries, lambda k, v: F.when(k == name, F.lit(replacement)).otherwise(v))


@dataclass(frozen=True)
class Redaction:
    """What stands in place of the value at a path: ``column``, ``column.field``, ``column.inner.field`` or ``column[].field``."""

    path: str
    replacement: str = REDACTED
    enabled: bool = True


def redact(df: DataFrame, rules: Sequence[Redaction | str] = REDACT_PATHS, replacement: str = REDACTED) -> DataFrame:
    """Replace the values at the rules' paths; ``redacted_paths`` lists the hits.

    Columns are texts, structs at any depth that may end in a map of texts, or arrays of structs. A path that is
    absent or NULL is no hit and stays. Plain paths take the common ``replacement``.
    """
    rules = [rule if isinstance(rule, Redaction) else Redaction(rule, replacement) for rule in rules]
    hits = []
    for rule in sorted((r for r in rules if r.enabled), key=lambda r: r.path):
        column, *steps = rule.path.replace("[]", ".[]").split(".")
        kind = next((f.dataType for f in df.schema.fields if f.name == column), None)
        found = kind is not None and _masked(F.col(column), kind, steps, rule.replacement)
        if found:
            # the hit is decided on the untouched document, so order of the paths does not matter
            hits.append((rule.path, column, F.coalesce(found[0], F.lit(False)), found[1]))
    out = df.withColumn("redacted_paths", F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, _, p, _ in hits])))
    for _, column, present, masked in hits:
        out = out.withColumn(column, F.when(present, masked).otherwise(F.col(column)))
    return out


def _masked(value: Column, kind: DataType, steps: Sequence[str], replacement: str) -> tuple[Column, Column] | None:
    """Is there something at the steps, and the value with it replaced; None if the type has no such path."""
    if not steps:
        return value.isNotNull(), F.lit(replacement)
    head, *rest = steps
    if head == "[]" and isinstance(kind, ArrayType):
        inner = _masked(F.col("x"), kind.elementType, rest, replacement)
        if inner is None:
            return None
        hit = lambda x: F.coalesce(_masked(x, kind.elementType, rest, replacement)[0], F.lit(False))
        mask = lambda x: F.when(hit(x), _masked(x, kind.elementType, rest, replacement)[1]).otherwise(x)
        return F.exists(value, hit), F.transform(value, mask)
    if isinstance(kind, MapType) and not rest:
        return F.map_contains_key(value, F.lit(head)), _mask_entry(value, head, replacement)
    if isinstance(kind, StructType) and head in kind.fieldNames():
        inner = _masked(value[head], kind[head].dataType, rest, replacement)
        if inner is None:
            return None
        present, masked = inner
        return present, value.withField(head, F.when(present, masked).otherwise(value[head]))
    return None


def pseudonymize(subject: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of the collapsed subject; NULL for a blank one."""
    if not secret:
        raise ValueError("secret required")
    text = norm_token(subject)
    return F.when(text != "", hmac_sha256(secret, text))


def retention(
    df: DataFrame,
    ts: str,
    now: Column,
    max_age_days: int = PERSONAL_DAYS,
    action: str | None = None,
    per_action_days: dict[str, int] | None = None,
    expire_invalid: bool = False,
) -> DataFrame:
    """Add ``keep`` and ``reason``: within the age limit of the action, or by the rule for bad times."""
    text = norm_token(F.col(ts).cast("string"))
    when = F.try_to_timestamp(text)
    days = F.lit(max_age_days)
    if action and per_action_days:
        overrides = F.create_map(*[F.lit(x) for kv in per_action_days.items() for x in kv])
        days = F.coalesce(overrides[F.col(action)], days)
    cutoff = now.cast("timestamp") - F.make_dt_interval(days=days)
    bad = "expired:" if expire_invalid else "keep:"
    reason = (
        F.when(text == "", F.lit(bad + "missing_ts"))
        .when(when.isNull(), F.lit(bad + "invalid_ts"))
        .when(when >= cutoff, F.lit("keep:within_window"))
        .otherwise(F.lit("expired:outside_window"))
    )
    return df.withColumn("reason", reason).withColumn("keep", F.col("reason").startswith("keep:"))


def attest(doc: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text."""
    return F.sha2(canonical_json(doc), 256)


def change_records(df: DataFrame, detail: str) -> DataFrame:
    """Sorted names of the fields present in the detail document, as ``fields``."""
    names = F.sort_array(F.map_keys(F.from_json(detail, "map<string,string>")))
    return df.withColumn("fields", F.coalesce(names, F.array().cast("array<string>")))
