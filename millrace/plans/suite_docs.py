"""Queries: document paths, mapping, cleaning, expansion, enrichment and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import documents
from ..session import spread
from .registry import query, table


def event_docs(spark, sf):
    """Events as untidy JSON documents."""
    note = F.when(F.col("event_type") == "error", " N/A ").when(F.col("event_type") == "view", "  ").otherwise(" a   b ")
    doc = F.to_json(
        F.struct(
            F.col("event_id").alias("Id"),
            F.concat(F.lit("  "), "event_type", F.lit("  x ")).alias(" Type "),
            F.col("value").cast("string").alias("value"),
            note.alias("note"),
            F.struct(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("gone")).alias("user"),
            F.array(F.col("event_type"), F.lit(None).cast("string"), F.lit("z")).alias("tags"),
        ),
        {"ignoreNullFields": "false"},
    )
    return spread(table(spark, sf, "events"), "event_id").withColumn("doc", doc)


def variants(spark, sf):
    return event_docs(spark, sf).withColumn("v", F.parse_json("doc"))


@query("get_path", "select event_id, user_id, event_type as tag, value::varchar as value, null::varchar as absent from events")
def _(spark, sf):
    v = variants(spark, sf)
    return v.select(
        "event_id",
        documents.get_path(F.col("v"), "user.id", "bigint").alias("user_id"),
        documents.get_path(F.col("v"), "tags[0]").alias("tag"),
        documents.get_path(F.col("v"), "value").alias("value"),
        documents.get_path(F.col("v"), "tags[0].none").alias("absent"),
    )


@query("map_fields", "select event_id, user_id as who, event_type as kind, value as amount from events")
def _(spark, sf):
    mapping = {"user.id": "dims.who", "tags[0]": "dims.kind", "value": "measures.amount"}
    types = {"dims.who": "bigint", "measures.amount": "double"}
    rec = variants(spark, sf).select("event_id", documents.map_fields(F.col("v"), mapping, types).alias("r"))
    return rec.select("event_id", "r.dims.who", "r.dims.kind", "r.measures.amount")


def _edited(*edits):
    def run(spark, sf):
        return documents.edit_documents(event_docs(spark, sf).select("event_id", "doc"), "doc", edits).withColumnRenamed("doc", "v")

    return run


def _show(run, **paths):
    return lambda spark, sf: run(spark, sf).select(
        "event_id", *[documents.get_path(F.col("v"), p).alias(n) for n, p in paths.items()]
    )


query("op_set", "select event_id, 'eu' as region, event_type as tag from events")(
    _show(_edited({"kind": "set", "to": "geo.region[0].name", "value": "eu"}), region="geo.region[0].name", tag="tags[0]")
)
query("op_delete", "select event_id, null::varchar as note, 'z' as second from events")(
    _show(_edited({"kind": "delete", "from": "note"}, {"kind": "delete", "from": "tags[1]"}, {"kind": "delete", "from": "no.such"}), note="note", second="tags[1]")
)
query("op_rename", "select event_id, null::varchar as old, user_id::varchar as new from events")(
    _show(_edited({"kind": "rename", "from": "user.id", "to": "owner.key"}, {"kind": "rename", "from": "x", "to": "y"}), old="user.id", new="owner.key")
)
query("op_copy", "select event_id, user_id::varchar as old, user_id::varchar as new from events")(
    _show(_edited({"kind": "copy", "from": "user", "to": "owner"}), old="user.id", new="owner.id")
)


@query("drop_nulls", "select event_id, 'user.gone' as dropped, 3::bigint as tags from events")
def _(spark, sf):
    out = documents.drop_nulls(event_docs(spark, sf).select("event_id", "doc"), "doc", levels=2)
    tags = F.size(documents.get_path(F.col("doc"), "tags", "array<string>")).cast("bigint")
    return out.select("event_id", F.array_join("dropped", ",").alias("dropped"), tags.alias("tags"))


@query(
    "coerce",
    "select event_id, value as value, user_id as user_id, 'tags[0]:int' as errors from events",
)
def _(spark, sf):
    out = documents.coerce(variants(spark, sf).select("event_id", "v"), "v", {"value": "float", "user.id": "int", "tags[0]": "int"})
    return out.select("event_id", "value", "user_id", F.array_join("coerce_errors", ",").alias("errors"))


@query("add_meta", "select event_id, 't1' as tenant, 'events' as source, ts as meta_ts from events")
def _(spark, sf):
    out = documents.add_meta(table(spark, sf, "events"), {"tenant": "t1", "source": "events"}, F.col("ts"))
    return out.select("event_id", "_meta.tenant", "_meta.source", F.col("_meta.ts").alias("meta_ts"))


@query(
    "profile_match",
    """select doc_id, case when lang = 'en' and source = 'src1' then 'exact' when lang = 'en' then 'english' else 'default' end as profile
    from documents""",
)
def _(spark, sf):
    rules = [("exact", {"lang": "en", "source": "src1"}), ("english", {"lang": "en", "source": "*"}), ("default", {})]
    return documents.match_profile(table(spark, sf, "documents"), rules).select("doc_id", "profile")


@query(
    "clean_document",
    """select event_id, event_type || ' x' as type, case when event_type in ('error', 'view') then null else 'a b' end as note from events""",
)
def _(spark, sf):
    out = documents.clean_documents(event_docs(spark, sf).select("event_id", "doc"), "doc", levels=2)
    return out.select(
        "event_id", documents.get_path(F.col("doc"), "type").alias("type"), documents.get_path(F.col("doc"), "note").alias("note")
    )


@query(
    "flatten_paths",
    """select event_id, path, type, value from (select event_id, unnest([
      {path: 'Id', type: 'number', value: event_id::varchar}, {path: ' Type ', type: 'string', value: '  ' || event_type || '  x '},
      {path: 'value', type: 'string', value: value::varchar}, {path: 'note', type: 'string', value: case event_type when 'error' then ' N/A ' when 'view' then '  ' else ' a   b ' end},
      {path: 'user.id', type: 'number', value: user_id::varchar}, {path: 'user.gone', type: 'null', value: null},
      {path: 'tags[0]', type: 'string', value: event_type}, {path: 'tags[1]', type: 'null', value: null}, {path: 'tags[2]', type: 'string', value: 'z'}],
      recursive := true) from events)""",
)
def _(spark, sf):
    return documents.flatten_paths(event_docs(spark, sf), ["event_id"], "doc")


def payloads(spark, sf):
    """The orders of every customer as one payload in each of the known shapes."""
    o = spread(table(spark, sf, "orders"), "o_custkey").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("o")
    )
    key, price = F.col("o.o_orderkey"), F.col("o.o_totalprice")
    objects = F.transform("o", lambda x: F.struct(x["o_orderkey"].alias("k"), x["o_totalprice"].alias("p")))
    pairs = F.transform("o", lambda x: F.array(x["o_orderkey"].cast("double"), x["o_totalprice"]))
    keyed = F.map_from_arrays(F.transform(key, lambda k: F.concat(F.lit("o"), k.cast("string"))), objects)
    cells = F.transform("o", lambda x: F.array(x["o_orderkey"].cast("string"), x["o_totalprice"].cast("string")))
    shapes = {
        "array": F.to_json(objects),
        "results": F.to_json(F.struct(objects.alias("Results"))),
        "pairs": F.to_json(F.struct(pairs.alias("prices"), pairs.alias("total_volumes"))),
        "keyed": F.to_json(keyed),
        "hourly": F.to_json(F.struct(F.lit(1.5).alias("latitude"), F.struct(key.alias("time"), price.alias("p")).alias("hourly"))),
        "header": F.to_json(F.concat(F.array(F.array(F.lit("k"), F.lit("p"))), cells)),
        "single": F.to_json(F.struct(F.size("o").alias("k"), F.array_max(price).alias("p"))),
    }
    cases = F.array(*[F.struct(F.lit(n).alias("shape"), c.alias("payload")) for n, c in shapes.items()])
    return o.select("o_custkey", F.explode(cases).alias("c")).select("o_custkey", "c.shape", "c.payload")


@query(
    "expand_records",
    """select o_custkey, shape, n, round(total, 2) as total from (
      select o_custkey, count(*) as n, sum(o_totalprice) as total from orders group by 1),
      (values ('array'), ('results'), ('pairs'), ('keyed'), ('hourly'), ('header')) t(shape)
    union all select o_custkey, 'single', 1, round(max(o_totalprice), 2) from orders group by 1""",
)
def _(spark, sf):
    rec = documents.expand_records(payloads(spark, sf), "payload")
    amount = F.coalesce(
        documents.get_path(F.col("record"), "p", "double"), documents.get_path(F.col("record"), "price", "double")
    )
    return rec.groupBy("o_custkey", "shape").agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("total"))


@query(
    "rows_to_table",
    """select event_id, case when event_type <> 'error' then event_type end as kind, json_extract_string(props, '$.k') as k,
    case when event_type = 'error' then user_id::varchar end as user from events""",
)
def _(spark, sf):
    ragged = F.to_json(
        F.struct(
            F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
            F.get_json_object("props", "$.k").alias("k"),
            F.when(F.col("event_type") == "error", F.col("user_id")).alias("user"),
        )
    )
    return documents.rows_to_table(table(spark, sf, "events").withColumn("doc", ragged), "doc", ["event_id"])


@query("enrich_static", "select event_id, 'eu' as region, 'static' as source from events")
def _(spark, sf):
    out = documents.enrich_static(table(spark, sf, "events"), {"region": "eu"})
    return out.select("event_id", F.col("_enrich")["region"]["value"].alias("region"), F.col("_enrich")["region"]["source"].alias("source"))


@query(
    "enrich_derived",
    """select event_id, 't-' || user_id as tenant, 'derived' as source, sha256('{"k":' || json_extract_string(props, '$.k') || '}') as doc_sha256 from events""",
)
def _(spark, sf):
    tenant = F.concat(F.lit("t-"), F.col("user_id").cast("string"))
    e = F.col("_enrich")
    out = documents.enrich_derived(table(spark, sf, "events"), "props", {"tenant": tenant})
    return out.select(
        "event_id",
        e["tenant"]["value"].alias("tenant"),
        e["tenant"]["source"].alias("source"),
        e["doc_sha256"]["value"].alias("doc_sha256"),
    )


@query(
    "fill_time_dims",
    "select event_id, strftime(ts, '%Y-%m-%d') as date, case when event_type = 'view' then 1999 else year(ts)::int end as year, month(ts)::int as month from events",
)
def _(spark, sf):
    rows = table(spark, sf, "events").withColumn("year", F.when(F.col("event_type") == "view", 1999))
    return documents.fill_time_dims(rows, "ts").select(
        "event_id", F.col("date").cast("string").alias("date"), "year", "month"
    )


@query("coerce_measures", "select event_id, value as value, 1::bigint as kept from events")
def _(spark, sf):
    m = F.create_map(F.lit("value"), F.concat(F.lit(" "), F.col("value").cast("string")), F.lit("type"), F.col("event_type"))
    out = table(spark, sf, "events").select("event_id", documents.coerce_measures(m).alias("m"))
    return out.select("event_id", F.col("m")["value"].alias("value"), F.size("m").cast("bigint").alias("kept"))


@query(
    "dims_from_id",
    """select p_partkey, case when p_size % 3 = 0 then null else lower(p_type) || '-' || p_size end as crypto_id,
    case when p_size % 3 = 0 then null else '30d' end as timeframe from part""",
)
def _(spark, sf):
    coin = F.concat(F.lit("crypto-"), F.lower("p_type"), F.lit("-"), F.col("p_size").cast("string"), F.lit("-30d"))
    ident = F.when(F.col("p_size") % 3 == 0, F.lit("crypto-top10-30d")).otherwise(coin)
    return table(spark, sf, "part").select("p_partkey", documents.dims_from_id(ident).alias("d")).select("p_partkey", "d.*")


@query("coerce_numbers", "select event_id, value as value, '0' || user_id as code from events")
def _(spark, sf):
    doc = F.to_json(F.struct(F.col("value").cast("string").alias("value"), F.concat(F.lit("0"), F.col("user_id").cast("string")).alias("code")))
    out = documents.coerce_numbers(table(spark, sf, "events").select("event_id", doc.alias("v")), "v")
    return out.select(
        "event_id", documents.get_path(F.col("v"), "value", "double").alias("value"), documents.get_path(F.col("v"), "code").alias("code")
    )


@query("record_id", """select event_id, 'sha256:' || sha256('{"k":' || json_extract_string(props, '$.k') || '}') as record_id from events""")
def _(spark, sf):
    return documents.with_record_id(table(spark, sf, "events"), "props").select("event_id", "record_id")


@query(
    "event_id",
    """select event_id as source_id, substr(sha256(strlen(user_id::varchar) || ':' || user_id || '|' || strlen(event_type) || ':' || event_type ||
      '|27:' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '|' || strlen(props) || ':' || props), 1, 16) as event_id,
      substr(sha256(user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '|' || props), 1, 16) as plain_id
    from events""",
)
def _(spark, sf):
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parts = F.col("user_id").cast("string"), F.col("event_type"), when, F.col("props")
    ids = hashing.event_id(*parts).alias("event_id"), hashing.event_id(*parts, plain=True).alias("plain_id")
    return table(spark, sf, "events").select(F.col("event_id").alias("source_id"), *ids)


@query(
    "idempotency_key",
    """select event_id, 'v1:t_' || user_id || ':' || event_type || ':' ||
    sha256(length(event_id::varchar) || ':' || event_id || '|' || length(props) || ':' || props) as key,
    case when event_type <> 'view' then 'v1:local:' || event_type || ':' || sha256('4:kind|' || length(event_type) || ':' || event_type || '|4:user|' || length(user_id::varchar) || ':' || user_id) end as named
    from events""",
)
def _(spark, sf):
    parts = [F.col("event_id").cast("string"), F.col("props")]
    key = hashing.idempotency_key(F.concat(F.lit(" T_:"), F.col("user_id").cast("string")), F.upper("event_type"), parts)
    fields = F.create_map(F.lit(" User"), F.col("user_id").cast("string"), F.lit("KIND "), F.col("event_type"), F.lit(" "), F.lit("x"))
    scope = F.when(F.col("event_type") == "view", "no scope").otherwise(F.col("event_type"))
    named = hashing.idempotency_key_of_map(F.lit(" : "), scope, fields)
    return table(spark, sf, "events").select("event_id", key.alias("key"), named.alias("named"))


@query("partition_key", "select event_id, user_id || '/' || event_type || '/' || strftime(ts, '%Y-%m-%d') as key from events")
def _(spark, sf):
    key = documents.partition_key(F.col("user_id").cast("string"), F.col("event_type"), F.col("ts"))
    return table(spark, sf, "events").select("event_id", key.alias("key"))


@query(
    "shard_for",
    """with keys as (select user_id, event_type, lower(user_id || '|' || event_type) as k from events),
    hashed as (select user_id, event_type, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::hugeint)),
      lambda h, b: (((h - h % 256 + xor((h % 256)::int, b::int)) % 16777216) * 1099511627776 + (h - h % 256 + xor((h % 256)::int, b::int)) * 435) % 18446744073709551616::hugeint) as h from keys)
    select (h % 16)::bigint as shard, count(*) as rows from hashed group by 1""",
)
def _(spark, sf):
    tenant, job = F.concat(F.lit(" "), F.col("user_id").cast("string")), F.concat(F.upper("event_type"), F.lit(" "))
    shard = hashing.shard_for(tenant, job, 16)
    return spread(table(spark, sf, "events"), "event_id").groupBy(shard.alias("shard")).agg(F.count("*").alias("rows"))


# --- scalar clean-up, seen through the tables ---------------------------------------------------


@query(
    "scalar_text",
    """select c_custkey, regexp_replace(lower(c_name), '#', '', 'g') || '@example.com' as email,
      case when length(lpad(c_custkey::varchar, 10, '5')) = 10 then '+1' || lpad(c_custkey::varchar, 10, '5') end as phone,
      (case when c_acctbal < 0 then '-' else '' end) || printf('%.2f', abs(c_acctbal)) as money,
      'C Mktsegment' as label from customer""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    raw_mail = F.concat(F.lit(" "), F.upper(F.regexp_replace("c_name", "#", "")), F.lit("@Example.com "))
    raw_phone = F.concat(F.lit("1-("), F.regexp_replace(F.lpad(F.col("c_custkey").cast("string"), 10, "5"), "^(...)(...)", "$1) $2-"))
    raw_money = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs("c_acctbal"), 2))
    return c.select(
        "c_custkey",
        text.email(raw_mail).alias("email"),
        text.phone_us(raw_phone).alias("phone"),
        text.money(raw_money).alias("money"),
        text.label_of(F.lit("rows[0].c_mktsegment")).alias("label"),
    )


@query("scalar_dates", "select o_orderkey, o_priority, strftime(o_orderdate, '%Y-%m-%d') as day from (select *, left(o_orderpriority, 1) as o_priority from orders)")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_priority", F.left("o_orderpriority", F.lit(1)))
    raw = F.lit(None).cast("string")
    for i, layout in enumerate(text.DATE_LAYOUTS, 1):
        raw = F.when(F.col("o_priority") == str(i), F.date_format("o_orderdate", layout)).otherwise(raw)
    return o.select("o_orderkey", "o_priority", text.date_iso(raw).alias("day"))
