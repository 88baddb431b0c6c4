"""Profile-driven ingest: payload to mapped, checked, identified records in one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import record_id
from ..operators import contracts, documents, quarantine
from ..session import materialize


@dataclass(frozen=True)
class Profile:
    """What one source delivers and how its fields map to dims and measures."""

    id: str
    mapping: Mapping[str, str]
    types: Mapping[str, str] = field(default_factory=dict)
    rules: Sequence[tuple[str, str, bool]] = ()
    schema: Mapping | None = None
    static: Mapping[str, str] = field(default_factory=dict)


def run(payloads: DataFrame, payload: str, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Records and quarantined rows of a payload frame.

    Expand, check, map, coerce and identify are projections: nothing is shuffled before the records
    are deduplicated by a sink. Payloads are read once: mapped records and the texts of quarantined and unreadable ones are
    written next to the checkpoints, and both outputs start from there.
    """
    rest = [c for c in payloads.columns if c != payload]
    rows = documents.expand_records(payloads, payload, unreadable="__text")
    readable = F.col("pos").isNotNull()
    found = contracts.validate_rules(F.col("record"), profile.rules)
    if profile.schema:
        found = F.concat(found, contracts.validate_contract(profile.schema, F.col("record")))
    not_object = F.when(F.try_variant_get("record", "$", "struct<>").isNull(), F.lit("not_an_object"))
    checked = rows.withColumn("violations", F.when(readable, F.concat(found, contracts.tokens(not_object))))
    mapped = documents.map_fields(F.col("record"), profile.mapping, profile.types) if profile.mapping else F.col("record")
    valid = F.size("violations") == 0
    data, text = F.when(valid, mapped), F.when(~readable, F.col("__text")).when(~valid, F.to_json("record"))
    written = materialize(checked.select(*rest, "pos", "violations", data.alias("__data"), text.alias("__text")))
    good, bad = quarantine.split(written)
    out = good.withColumn("data", F.col("__data")).drop("__data", "__text")
    if profile.static:
        out = documents.enrich_static(out, profile.static)
    out = out.withColumn("profile_id", F.lit(profile.id)).withColumn("record_id", record_id(F.to_json("data")))
    broken = written.where(~readable).withColumn("reason", F.lit("parse_error"))
    flagged = bad.withColumn("reason", F.lit("schema_violation")).unionByName(broken)
    return out, flagged.withColumn("payload", F.col("__text")).drop("__data", "__text")
