"""Queries: audit trail, hash chains, schema profiling, telemetry labels and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, profiler, telemetry
from ..session import materialize
from .registry import query, table
from .suite_docs import event_docs
from .suite_tables import audited


@query(
    "audit_append",
    """select user_id, min(event_id) as event_id, event_type from events where (user_id, event_type) not in
    (select user_id, event_type from events where value > 150) group by user_id, event_type""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    log = rows.where("value > 150").drop("value")
    return audit.append(log, rows.drop("value"), ["user_id", "event_type"], ["event_id"])


@query(
    "audit_evict",
    """with log as (select user_id, event_id, case when event_type <> 'error' then ts end as ts from events where value > 20
      union all select user_id, event_id, case when event_type <> 'error' then ts end from events where value <= 20),
    ranked as (select *, row_number() over (order by coalesce(ts, timestamp '1970-01-01') desc, user_id desc, event_id desc) as k from log)
    select user_id, event_id, ts is not null as dated from ranked where k <= 4321""",
)
def _(spark, sf):
    """The newest 4321 records: the bound is the feature."""
    when = F.when(F.col("event_type") == "error", "yesterday").otherwise(F.col("ts").cast("string")).alias("when")
    rows = table(spark, sf, "events").select("user_id", "event_id", "value", when)
    log, incoming = rows.where("value > 20").drop("value"), rows.drop("value")
    out = audit.append_bounded(log, incoming, ["user_id", "event_id"], ["when"], 4321, "when")
    return out.select("user_id", "event_id", (F.col("when") != "yesterday").alias("dated"))


@query(
    "audit_verify_events",
    """with a as (select user_id, case when event_type = 'view' then -1 else event_id end as id, event_type, event_id from events),
    d as (select user_id, id from a group by 1, 2 having count(*) > 1)
    select event_id, array_to_string(list_filter([case when event_type = 'click' then 'missing:action' end, case when event_type = 'error' then 'invalid:when' end,
      case when (user_id, id) in (select user_id, id from d) then 'duplicate:event_id' end], lambda x: x is not null), ',') as problems from a
    where event_type in ('click', 'error') or (user_id, id) in (select user_id, id from d)""".replace("invalid:when", "invalid:ts"),
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("tenant"),
        F.when(F.col("event_type") == "view", -1).otherwise(F.col("event_id")).cast("string").alias("id"),
        F.when(F.col("event_type") == "error", "yesterday").otherwise(F.col("ts").cast("string")).alias("when"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("action"),
        F.col("event_id").alias("source_id"),
    )
    out = audit.verify_events(rows, "tenant", "id", "when", "action")
    return out.select(F.col("source_id").alias("event_id"), F.array_join("problems", ",").alias("problems"))


CANON_SQL = "event_id || '|' || event_type || '|' || props"
CHAIN_SQL = f"""o as materialized (select user_id, event_id, {CANON_SQL} as text, row_number() over (partition by user_id order by ts, event_id) as i from events),
c as (select user_id, event_id, i, 'GENESIS' as prev_hash, sha256('GENESIS' || chr(10) || text) as hash from o where i = 1
  union all select o.user_id, o.event_id, o.i, c.hash, sha256(c.hash || chr(10) || o.text) from c join o on o.user_id = c.user_id and o.i = c.i + 1)"""


def canonical():
    return F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")


def chained(spark, sf):
    return audit.chain_build(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], canonical())


@query("chain_build", f"with recursive {CHAIN_SQL} select user_id, event_id, prev_hash, hash from c")
def _(spark, sf):
    return chained(spark, sf).select("user_id", "event_id", "prev_hash", "hash")


query("chain_links", f"with recursive {CHAIN_SQL} select user_id, event_id, prev_hash from c")(
    lambda spark, sf: chained(spark, sf).select("user_id", "event_id", "prev_hash")
)


@query(
    "chain_verify",
    "select event_id, 'hash' as problems from events where event_type = 'error' and value > 150",
)
def _(spark, sf):
    tampered = (F.col("event_type") == "error") & (F.col("value") > 150)
    forged = chained(spark, sf).drop("idx").withColumn("props", F.when(tampered, '{"k": -1}').otherwise(F.col("props")))
    out = audit.chain_verify(forged, ["user_id"], ["ts", "event_id"], canonical())
    return out.select("event_id", F.array_join("problems", ",").alias("problems"))


@query(
    "chain_heads",
    """select user_id, case when user_id % 4 = 3 then 'missing' when user_id % 4 = 1 then case when n = 1 then 'missing' else 'cut' end else 'head' end as problems
    from (select user_id, count(*) as n, arg_max(event_type, (ts, event_id)) as last from events group by 1) where user_id % 4 <> 0""",
)
def _(spark, sf):
    keys, order = ["user_id"], ["ts", "event_id"]
    log = chained(spark, sf).drop("idx")
    heads = materialize(audit.chain_heads(log, keys, order))
    kind = F.col("user_id") % 4
    last = log.groupBy("user_id").agg(F.max_by("event_id", F.struct(*order)).alias("last_id"))
    cut = log.where(kind == 1).join(last, "user_id").where("event_id <> last_id").drop("last_id")
    altered = log.where(kind == 2).drop("prev_hash", "hash").withColumn("props", F.lit('{"k": -1}'))
    again = audit.chain_build(altered, keys, order, canonical()).drop("idx")
    forged = log.where(kind == 0).unionByName(cut).unionByName(again)
    out = audit.verify_heads(forged, keys, order, heads)
    return out.select("user_id", F.array_join("problems", ",").alias("problems"))


ENVELOPE = ["c_custkey", "c_name", "c_mktsegment"]
ENVELOPE_SQL = """sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}')"""


@query("envelope_hash", f"select c_custkey, {ENVELOPE_SQL} as hash from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", audit.envelope_hash(ENVELOPE).alias("hash"))


@query("verify_envelope", "select c_custkey from customer where c_acctbal < 0")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("hash", audit.envelope_hash(ENVELOPE))
    changed = c.withColumn("c_name", F.when(F.col("c_acctbal") < 0, "changed").otherwise(F.col("c_name")))
    return audit.verify_envelope(changed, ENVELOPE, "hash").select("c_custkey")


@query(
    "observation_id",
    """select event_id, sha256(user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d') || '|a=1|kind=' || event_type) as id from events""",
)
def _(spark, sf):
    meta = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("a"), F.lit("1"))
    fields = [F.col("user_id").cast("string"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd")]
    return table(spark, sf, "events").select("event_id", audit.observation_id(fields, meta).alias("id"))


# --- schema profiling -------------------------------------------------------------------------

FIELDS_SQL = """select * from (values (' Type ', 'Type', 'string'), ('Id', 'Id', 'number'), ('note', 'Note', 'string'), ('tags[0]', 'Tags', 'array'),
  ('user.gone', 'Gone', 'null'), ('user.id', 'Id', 'number'), ('value', 'Value', 'string')) f(path, label, type)"""


def fields(spark, sf):
    return profiler.infer_fields(event_docs(spark, sf), "doc", ["event_id"])


@query(
    "infer_fields",
    f"""select path, label, type, case path when 'tags[0]' then 2 * n when 'user.gone' then 0 else n end as filled,
    case path when ' Type ' then '  ' || event_type || '  x ' when 'Id' then event_id::varchar when 'tags[0]' then event_type when 'user.id' then user_id::varchar
      when 'note' then case event_type when 'error' then ' N/A ' when 'view' then '  ' else ' a   b ' end when 'value' then value::varchar end as sample
    from ({FIELDS_SQL}), (select count(*) as n from events), (select * from events order by event_id limit 1)""",
)
def _(spark, sf):
    return fields(spark, sf).select("path", "label", "type", "filled", "sample")


@query(
    "auto_map",
    """select * from (values (' Type ', 'dims.type'), ('Id', 'measures.id'), ('note', 'dims.note'), ('tags[0]', 'dims.tags.0'),
    ('user.gone', 'dims.user.gone'), ('user.id', 'measures.user.id'), ('value', 'measures.value')) t(path, target)""",
)
def _(spark, sf):
    return profiler.auto_map(fields(spark, sf)).select("path", "target")


@query(
    "score_fields",
    """select * from (values ('Id', 'metric', 1::bigint, 1::bigint), ('user.id', 'metric', 1, 2), (' Type ', 'join', 1, 1), ('note', 'join', 1, 2), ('value', 'join', 1, 3))
    t(path, role, score, rank)""",
)
def _(spark, sf):
    return profiler.score_fields(fields(spark, sf)).select("path", "role", "score", "rank")


@query(
    "suggest_join_keys",
    """with c as (select distinct c_nationkey as k from customer), s as (select distinct s_nationkey as k from supplier)
    select 'nation id' as label, 3::bigint as score, (select count(*) from c) as keys_a, (select count(*) from s) as keys_b,
      (select count(*) from c join s using (k)) as shared, round((select count(*) from c join s using (k)) / least((select count(*) from c), (select count(*) from s))::double, 6) as overlap
    union all select 'name', 3, (select count(distinct c_name) from customer), (select count(distinct s_name) from supplier), 0, 0""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("spent"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("Nation-ID"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("owed"))
    return profiler.suggest_join_keys(a, b).withColumn("overlap", F.round("overlap", 6))


@query(
    "schema_drift",
    """select * from (values ('value', 'type_changed', 'string', 'number'), ('user.gone', 'removed', 'null', ''), ('note', 'optional_changed', 'false', 'true'),
    ('extra', 'added', '', 'string'), ('note', 'type_changed', 'string', 'number')) t(path, drift, "from", "to")""",
)
def _(spark, sf):
    n = F.col("filled")
    old = fields(spark, sf).select("path", "type", (n == 0).alias("optional"))
    doc = F.to_json(
        F.struct(
            F.col("event_id").alias("Id"),
            F.lit("x").alias(" Type "),
            "value",
            F.length("props").alias("note"),
            F.struct(F.col("user_id").alias("id")).alias("user"),
            F.array("event_type").alias("tags"),
            F.lit("y").alias("extra"),
        )
    )
    new = profiler.infer_fields(table(spark, sf, "events").withColumn("doc", doc), "doc", ["event_id"])
    new = new.select("path", "type", F.col("path").isin("note").alias("optional"))
    return profiler.schema_drift(old, new)


# --- telemetry --------------------------------------------------------------------------------


@query(
    "normalize_labels",
    """select event_id, 'host=' || repeat('h', 300) || ';type=' || event_type as labels, 'name:,long_value:host,name:bad name!' as problems,
    sha256('host' || chr(0) || repeat('h', 300) || chr(0) || 'type' || chr(0) || event_type || chr(0)) as fingerprint from events""",
)
def _(spark, sf):
    raw = F.create_map(
        F.lit(" Type "), F.concat(F.lit(" "), "event_type"), F.lit("HOST"), F.repeat(F.lit("h"), 300), F.lit("bad name!"), F.lit("x"), F.lit(" "), F.lit("y")
    )
    rows = table(spark, sf, "events").select("event_id", telemetry.normalize_labels(raw).alias("m"), telemetry.label_problems(raw).alias("p"))
    pairs = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("event_id", pairs.alias("labels"), F.array_join("p", ",").alias("problems"), telemetry.fingerprint(F.col("m")).alias("fingerprint"))


@query(
    "normalize_spans",
    """with s as (select event_id, user_id, min(event_id) over (partition by user_id) as root, value from events where event_type <> 'error')
    select user_id::varchar as trace_id, s.event_id::varchar as span_id, round(s.value, 6) as seconds, round(p.value, 6) as parent_seconds
    from s left join (select event_id, value from s) p on p.event_id = s.root and s.event_id <> s.root""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    roots = e.where("event_type <> 'error'").groupBy("user_id").agg(F.min("event_id").alias("root"))
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    micros = F.round(F.col("value") * 1_000_000).cast("bigint")
    # errors end before they start, those of value 0 too
    took = F.when(F.col("event_type") == "error", -1 - F.abs(micros)).otherwise(micros)
    spans = e.join(roots, "user_id").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.when(F.col("event_id") != F.col("root"), F.col("root").cast("string")).alias("parent_id"),
        F.concat(F.lit("op  "), "event_type").alias("operation"),
        F.col("ts").alias("start"),
        F.timestamp_micros(start + took).cast("timestamp_ntz").alias("end"),
    )
    good, _ = telemetry.normalize_spans(spans)
    return good.select("trace_id", "span_id", F.round("seconds", 6).alias("seconds"), F.round("parent_seconds", 6).alias("parent_seconds"))
