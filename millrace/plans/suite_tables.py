"""Queries: grouped statistics, roll-ups, correlation, joins, deduplication, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import compliance, dedupe, joins
from .registry import query, table


def r(name, digits=6):
    return F.round(name, digits).alias(name)


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "group_stats",
    """select trim(event_type) as "group", count(*) as count, round(sum(value), 4) as sum, min(value) as min, max(value) as max,
    round(avg(value), 6) as mean, round(stddev_pop(value), 6) as stddev from events where trim(event_type) <> '' group by 1""",
)
def _(spark, sf):
    out = agg.group_stats(table(spark, sf, "events"), "event_type", "value")
    return out.select("group", "count", r("sum", 4), "min", "max", r("mean"), r("stddev"))


@query(
    "percentile_nr",
    """select event_type, p::double as percent, quantile_disc(value, list_value(0, 0.5, 0.9, 0.95, 1)[i]) as percentile from events,
    (values (1, 0), (2, 50), (3, 90), (4, 95), (5, 100)) t(i, p) group by event_type, i, p""".replace(
        "quantile_disc(value, list_value(0, 0.5, 0.9, 0.95, 1)[i])",
        """case i when 1 then quantile_disc(value, 0.0) when 2 then quantile_disc(value, 0.5) when 3 then quantile_disc(value, 0.9)
        when 4 then quantile_disc(value, 0.95) else quantile_disc(value, 1.0) end""",
    ),
)
def _(spark, sf):
    return agg.percentile_nearest(table(spark, sf, "events"), ["event_type"], "value", [0, 50, 90, 95, 100])


DIST_SQL = """o as (select event_type, value, row_number() over (partition by event_type order by value) as i,
    count(*) over (partition by event_type) as n from events),
d as (select event_type, count(*) as count, avg(value) as mean, stddev_pop(value) as stddev, min(value) as min, max(value) as max,
    median(value) as median, coalesce(median(value) filter (where i <= n // 2), min(value)) as q1,
    coalesce(median(value) filter (where i > n - n // 2), min(value)) as q3 from o group by 1)"""


@query(
    "dist_stats",
    f"""with {DIST_SQL} select event_type, count, round(mean, 6) as mean, round(stddev, 6) as stddev, min, max, round(median, 6) as median,
    round(q1, 6) as q1, round(q3, 6) as q3 from d""",
)
def _(spark, sf):
    out = agg.dist_stats(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", "count", r("mean"), r("stddev"), "min", "max", r("median"), r("q1"), r("q3"))


@query(
    "outlier_z",
    """select event_id, event_type, value, round(abs(value - m) / s, 6) as score from events join
    (select event_type, avg(value) as m, stddev_pop(value) as s from events group by 1) using (event_type)
    where s > 0 and abs(value - m) / s >= 3""",
)
def _(spark, sf):
    out = agg.outliers_z(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_id", "event_type", "value", r("score"))


@query(
    "outlier_iqr",
    f"""with {DIST_SQL} select event_id, event_type, value, case when value < q1 - 1.5 * (q3 - q1) then 'low' else 'high' end as side
    from events join d using (event_type) where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""",
)
def _(spark, sf):
    out = agg.outliers_iqr(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_id", "event_type", "value", "side")


@query(
    "results_summary",
    """select 'total' as kind, '' as name, count(*) as rows, count(distinct user_id) as drones from events
    union all select 'profile', event_type, count(*), count(distinct user_id) from events group by event_type""",
)
def _(spark, sf):
    return agg.results_summary(table(spark, sf, "events"), "event_type", "user_id")


@query("status_counts", "select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2")
def _(spark, sf):
    return agg.status_counts(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(
    "log_summary",
    """with e as (select distinct event_id, event_type, user_id from events where ts >= timestamp '2024-01-10'),
    c as (select 'event_type' as dim, event_type as name, count(*) as n from e group by 2
      union all select 'user_id', user_id::varchar, count(*) from e group by 2)
    select * from (select dim, name, n, row_number() over (partition by dim order by n desc, name) as rank from c) where rank <= 5""",
)
def _(spark, sf):
    return agg.log_summary(
        table(spark, sf, "events"), ["event_id"], "ts", stamp("2024-01-10"), ["event_type", "user_id"], 5
    )


@query(
    "heartbeat_stats",
    """select count(*) as total, count(*) filter (where not o) as active, count(*) filter (where o) as offline from
    (select user_id, timestamp '2024-01-30 12:00:00' - max(ts) > interval 6 hours as o from events
     where ts <= timestamp '2024-01-30 12:00:00' group by 1)""",
)
def _(spark, sf):
    beats = table(spark, sf, "events").where(F.col("ts") <= stamp("2024-01-30 12:00:00"))
    return agg.heartbeat_stats(beats, "user_id", "ts", stamp("2024-01-30 12:00:00"), 6 * 3600)


@query(
    "health_rollup",
    """with c as (select o_orderpriority as service, 'c-' || o_custkey as name,
        max(case o_orderstatus when 'P' then 3 when 'F' then 2 else 1 end) as rank from orders group by 1, 2)
    select service, count(*) as components, count(*) filter (where rank = 4) as fatal, count(*) filter (where rank = 3) as degraded,
      case max(rank) when 4 then 'fatal' when 3 then 'degraded' when 2 then 'ok' else 'unknown' end as overall from c group by 1""",
)
def _(spark, sf):
    checks = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("service"),
        F.concat(F.lit(" C-"), F.col("o_custkey").cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "P", "Degraded").when(F.col("o_orderstatus") == "F", "ok").otherwise("?").alias("status"),
    )
    return agg.health_rollup(checks, ["service"], "name", "status")


def event_labels():
    host = F.concat(F.lit("h"), F.pmod("user_id", F.lit(10)).cast("string"))
    return F.create_map(F.lit("type"), F.col("event_type"), F.lit("host"), host)


LABELS_SQL = "'host=h' || (user_id % 10) || ';type=' || event_type"


@query("counter_sum", f"select {LABELS_SQL} as labels, round(sum(value), 4) as total from events where value > 0 group by 1")
def _(spark, sf):
    return agg.counter_sum(table(spark, sf, "events"), event_labels(), "value").select("labels", r("total", 4))


@query("gauge_last", f"select {LABELS_SQL} as labels, arg_max(value, (ts, event_id)) as last from events group by 1")
def _(spark, sf):
    return agg.gauge_last(table(spark, sf, "events"), event_labels(), "value", ["ts", "event_id"])


@query(
    "histogram_cumulative",
    """select event_type, coalesce(b::double::varchar, '+Inf') as le, count(*) filter (where b is null or value <= b) as count from events,
    (values (5.0), (10.0), (25.0), (50.0), (100.0), (250.0), (null)) t(b) group by event_type, b""",
)
def _(spark, sf):
    return agg.histogram_cumulative(table(spark, sf, "events"), ["event_type"], "value", [5, 10, 25, 50, 100, 250])


@query(
    "index_projection",
    """select count(*) as constituents, round(avg(l_extendedprice), 4) as l_extendedprice, round(sum(l_quantity), 2) as l_quantity
    from lineitem where (l_returnflag || l_linestatus) like '%F' and l_quantity >= 10""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
    out = agg.index_projection(rows, "symbol", "F", "l_quantity", 10, ["l_extendedprice"], ["l_quantity"])
    return out.select("constituents", r("l_extendedprice", 4), r("l_quantity", 2))


def tickers(spark, sf):
    """One ticker per part: price, change against the list price, traded volume."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("volume"), F.round(F.avg("l_extendedprice"), 4).alias("price")
    )
    named = table(spark, sf, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    return named.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        "volume",
        "price",
        F.round((F.col("price") - F.col("p_retailprice")) / F.col("p_retailprice") * 100, 4).alias("pct_change"),
    )


TICK_SQL = """t as (select 'P' || p_partkey as symbol, volume, price, round((price - p_retailprice) / p_retailprice * 100, 4) as pct_change
  from part join (select l_partkey, sum(l_quantity) as volume, round(avg(l_extendedprice), 4) as price from lineitem group by 1)
  on p_partkey = l_partkey)"""


@query(
    "top_weighted_index",
    f"""with {TICK_SQL} select count(*) as members, round(avg(price), 4) as index from
    (select * from t where symbol like '%7' and volume > 0 and price > 0 order by volume desc, symbol limit 10)""",
)
def _(spark, sf):
    return agg.top_weighted_index(tickers(spark, sf), "symbol", "7", "volume", "price").select("members", r("index", 4))


@query(
    "topk_movers",
    f"""with {TICK_SQL} select * from (select symbol, pct_change, volume, 'gainers' as direction from t where symbol like '%7' and volume >= 100
      order by pct_change desc, symbol limit 10) union all select * from (select symbol, pct_change, volume, 'losers' from t
      where symbol like '%7' and volume >= 100 order by pct_change, symbol limit 10)""",
)
def _(spark, sf):
    t = tickers(spark, sf)
    sides = [
        agg.topk_movers(t, "symbol", "7", "volume", 100, "pct_change", 10, d).withColumn("direction", F.lit(d))
        for d in ("gainers", "losers")
    ]
    return sides[0].unionByName(sides[1]).select("symbol", "pct_change", "volume", "direction")


def customer_orders(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))


CO_SQL = "orders join customer on o_custkey = c_custkey"


@query(
    "pearson",
    f"select c_mktsegment, count(*) as n, round(corr(o_totalprice, c_acctbal), 6) as r from {CO_SQL} group by 1",
)
def _(spark, sf):
    out = agg.pearson(customer_orders(spark, sf), "o_totalprice", "c_acctbal", ["c_mktsegment"])
    return out.select("c_mktsegment", "n", r("r"))


@query(
    "corr_pvalue",
    f"""with c as (select c_mktsegment, count(*) as n, corr(o_totalprice, c_acctbal) as r from {CO_SQL} group by 1),
    t as (select *, abs(r) * sqrt((n - 2) / (1 - r * r)) as t from c)
    select c_mktsegment, n, round(r, 6) as r, round(1 - sum((case when k = 0 or k = 2000 then 1 when k % 2 = 1 then 4 else 2 end)
      * exp(-((t * k / 2000) ** 2) / 2)) * (t / 2000) / 3 * sqrt(2 / pi()), 6) as p_value
    from t, range(0, 2001) q(k) group by c_mktsegment, n, r, t""",
)
def _(spark, sf):
    out = agg.with_pvalue(agg.pearson(customer_orders(spark, sf), "o_totalprice", "c_acctbal", ["c_mktsegment"]))
    return out.select("c_mktsegment", "n", r("r"), r("p_value"))


@query(
    "corr_label",
    """select l_returnflag, round(r, 6) as r, case when abs(r) >= 0.8 then 'Strong correlation' when abs(r) >= 0.6 then 'Moderate correlation'
      when abs(r) >= 0.4 then 'Weak correlation' else 'Very weak correlation' end as label
    from (select l_returnflag, corr(l_quantity, l_extendedprice) as r from lineitem group by 1)""",
)
def _(spark, sf):
    out = agg.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", r("r"), agg.corr_label(F.col("r")).alias("label"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_matrix",
    " union all ".join(
        f"select l_returnflag, '{a}' as a, '{b}' as b, count(*) as n, round(corr({a}, {b}), 6) as r from lineitem group by 1"
        for i, a in enumerate(MEASURES)
        for b in MEASURES[i + 1 :]
    ),
)
def _(spark, sf):
    out = agg.corr_matrix(table(spark, sf, "lineitem"), MEASURES, ["l_returnflag"])
    return out.select("l_returnflag", "a", "b", "n", r("r"))


def runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.concat(F.lit("d"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("drone_id"),
        F.col("o_orderpriority").alias("profile_id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"),
        F.floor("o_totalprice").cast("bigint").alias("rows_out"),
        F.col("o_totalprice").alias("duration_ms"),
    )


RUNS_SQL = """runs as (select 'run-' || o_orderkey as run_id, 'd' || (o_custkey % 50) as drone_id, o_orderpriority as profile_id,
  o_orderdate as started_at, case when o_orderstatus = 'P' then 'failed' else 'succeeded' end as status,
  floor(o_totalprice)::bigint as rows_out, o_totalprice as duration_ms from orders)"""


@query(
    "run_rollup",
    f"""with {RUNS_SQL} select profile_id, count(*) as runs, sum(rows_out)::bigint as rows_out, count(*) filter (where status = 'failed') as failures,
    round(avg(duration_ms), 3) as mean_ms, quantile_disc(duration_ms, 0.95) as p95_ms from runs group by 1""",
)
def _(spark, sf):
    out = agg.run_rollup(runs(spark, sf), "profile_id")
    return out.select("profile_id", "runs", "rows_out", "failures", r("mean_ms", 3), "p95_ms")


@query("topic_summary", "select event_type as topic, count(distinct user_id) as sources, max(ts) as last_fetch from events group by 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("topic")).agg(
        F.count_distinct("user_id").alias("sources"), F.max("ts").alias("last_fetch")
    )


@query("object_stats", "select source as tenant, count(*) as objects, sum(strlen(text))::bigint as bytes from documents group by 1")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("tenant")).agg(
        F.count("*").alias("objects"), F.sum(F.octet_length("text")).alias("bytes")
    )


@query(
    "series_stats",
    """select count(*) as series, sum(n)::bigint as points, max(n) as longest from
    (select user_id, event_type, count(*) as n from events group by 1, 2)""",
)
def _(spark, sf):
    sizes = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("series"), F.sum("n").alias("points"), F.max("n").alias("longest"))


@query(
    "heat_grid",
    """with e as (select event_type as x, strftime(ts, '%Y-%m-%d') as y, value, ts, event_id from events),
    k as (select * from e where value is not null)
    select x, y, arg_max(value, (ts, event_id)) as value, (select min(value) from k) as min, (select max(value) from k) as max from k group by x, y""",
)
def _(spark, sf):
    cells = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return agg.heat_grid(cells, "event_type", "day", "value", ["ts", "event_id"])


@query(
    "distinct_set",
    """select o_custkey, array_to_string(list_sort(list(distinct o_orderpriority)), ',') as priorities,
    count(distinct o_orderpriority) as n from orders group by 1""",
)
def _(spark, sf):
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("s"))
    return sets.select("o_custkey", F.array_join("s", ",").alias("priorities"), F.size("s").cast("bigint").alias("n"))


# --- joins ------------------------------------------------------------------------------------


@query(
    "join_first_match",
    """with a as (select * from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn = 1)
    select o_custkey::varchar as join_value, o_orderkey, o_totalprice, c_custkey, c_acctbal from a join customer on o_custkey = c_custkey""",
)
def _(spark, sf):
    joined = joins.join_first_match(
        table(spark, sf, "orders"), table(spark, sf, "customer"), F.col("o_custkey"), F.col("c_custkey"), ["o_orderkey"]
    )
    return joined.select("join_value", "o_orderkey", "o_totalprice", "c_custkey", "c_acctbal")


@query(
    "join_multi_full",
    """select coalesce(c.k, s.k) as nation_key, c.v as "customer:balance", s.v as "supplier:balance" from
    (select c_nationkey as k, arg_max(c_acctbal, c_custkey) as v from customer group by 1) c full join
    (select s_nationkey as k, arg_max(s_acctbal, s_suppkey) as v from supplier group by 1) s on c.k = s.k""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation_key"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("seq"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation_key"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("seq"))
    return joins.join_multi_full({"customer": (c, ["balance"]), "supplier": (s, ["balance"])}, ["nation_key"], "seq")


ACTIONS = {"view": "Access  view", "click": "config change", "purchase": "Payment made", "signup": "Login with role", "error": "crash"}
ACTION_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in ACTIONS.items()) + " end"


def audited(spark, sf):
    """Events as audit records."""
    names = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return table(spark, sf, "events").withColumn("action", names[F.col("event_type")])


CONTROL_SQL = f"""select event_id, case event_type when 'view' then 'access,security' when 'click' then 'change_mgmt'
  when 'purchase' then 'financial_reporting' when 'signup' then 'access,security' else 'unknown' end as controls from events"""


def _controls(spark, sf):
    out = joins.rules_join(audited(spark, sf), "action", compliance.CONTROL_RULES)
    return out.select("event_id", F.array_join("controls", ",").alias("controls"))


query("join_rules_broadcast", CONTROL_SQL)(_controls)
OUTCOME_RULES = [
    *compliance.CONTROL_RULES,
    joins.ControlRule("crash", ("availability",), outcomes=("failure",)),
    joins.ControlRule("payment", ("fraud",), outcomes=("failure", "denied")),
    joins.ControlRule("login", ("never",), enabled=False),
]


@query(
    "map_controls",
    f"""select control, count(*) as events from (select unnest(string_split(controls, ',')) as control from ({CONTROL_SQL}) join events using (event_id)
      where not (event_type = 'error' and value > 50)
      union all select 'availability' from events where event_type = 'error' and value > 50
      union all select 'fraud' from events where event_type = 'purchase' and value > 50) group by 1""",
)
def _(spark, sf):
    rows = audited(spark, sf).withColumn("outcome", F.when(F.col("value") > 50, " Failure").otherwise("success"))
    mapped = joins.rules_join(rows, "action", OUTCOME_RULES, outcome="outcome")
    return mapped.select(F.explode("controls").alias("control")).groupBy("control").agg(F.count("*").alias("events"))


def _watched(spark, sf):
    rows = table(spark, sf, "customer").withColumn("symbol", F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")))
    listed = table(spark, sf, "nation").where("n_regionkey = 1").select("n_name")
    return joins.watchlist(rows, "symbol", listed)


query(
    "watchlist_filter",
    "select c_custkey, c_nationkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)",
)(lambda spark, sf: _watched(spark, sf).select("c_custkey", "c_nationkey"))

@query("anti_seen", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(spark, sf):
    seen = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti_seen(table(spark, sf, "customer"), seen, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "join_asof",
    """select l.event_id, l.user_id, l.ts, r.value as feature from (select * from events where event_type = 'purchase') l
    asof left join (select user_id, ts, value from events where event_type = 'view') r on l.user_id = r.user_id and l.ts >= r.ts""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("feature"))
    return joins.join_asof(left, right, ["user_id"], "ts", "feature")


# --- deduplication and sets -------------------------------------------------------------------


@query(
    "dedupe_by_path",
    """select k as dedupe_key, min(event_id) as event_id from (select json_extract_string(props, '$.k') as k, event_id from events)
    where trim(k) <> '' group by 1""",
)
def _(spark, sf):
    docs = table(spark, sf, "events").withColumn("doc", F.try_parse_json("props"))
    key = F.try_variant_get("doc", "$.k", "string")
    rows = docs.withColumn("__k", key).select("__k", "event_id")
    return dedupe.dedupe_by_path(rows, F.col("__k"), ["event_id"]).select("dedupe_key", "event_id")


POINT_ORDER = ["l_extendedprice", "l_orderkey", "l_linenumber"]


@query(
    "dedupe_points",
    "select l_returnflag as series, l_shipdate as ts, min(l_extendedprice) as value from lineitem group by 1, 2",
)
def _(spark, sf):
    out = dedupe.dedupe_points(table(spark, sf, "lineitem"), ["l_returnflag"], "l_shipdate", POINT_ORDER)
    return out.select(F.col("l_returnflag").alias("series"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"))


def _compacted(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"), "l_linestatus"
    )
    chunks = [lines.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("F", "O")]
    return dedupe.compact_series(chunks, ["series"], "ts", stamp("1996-01-01"), stamp("1998-01-01"), ["value"])


query(
    "compact_series",
    """select l_returnflag as series, l_shipdate as ts, min(l_extendedprice) as value from lineitem
    where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1998-01-01' group by 1, 2""",
)(lambda spark, sf: _compacted(spark, sf)[0])
query(
    "compact_report",
    """select l_returnflag as series, sum(n)::bigint as input_points, (sum(n) - count(*))::bigint as duplicates,
    count(*) filter (where l_shipdate < timestamp '1996-01-01' or l_shipdate >= timestamp '1998-01-01') as outside
    from (select l_returnflag, l_shipdate, count(*) as n from lineitem group by 1, 2) group by 1""",
)(lambda spark, sf: _compacted(spark, sf)[1])


@query(
    "upsert_point",
    """select user_id, event_type, arg_max(v, seq) as value, max(seq) as seq from (select user_id, event_type, value as v, event_id as seq from events
    union all select user_id, event_type, value * 2, event_id + 1000000000 from events where event_type = 'purchase') group by 1, 2""",
)
def _(spark, sf):
    stored = table(spark, sf, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    fresh = stored.where("event_type = 'purchase'").withColumns({"value": F.col("value") * 2, "seq": F.col("seq") + 1_000_000_000})
    return dedupe.upsert_points(stored, fresh, ["user_id", "event_type"], "seq")


@query(
    "union_profiles",
    """select c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
    union all select s_name, s_acctbal, null from supplier""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return dedupe.union_profiles([c, s])


@query("intersect_fields", "select c_nationkey as nation_key from customer intersect select s_nationkey from supplier")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation_key"))
    return c.intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("except_seen", "select c_custkey from customer except select o_custkey from orders where o_orderpriority = '5-LOW'")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").exceptAll(
        table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select("o_custkey").distinct()
    )


@query(
    "merge_labels",
    "select event_id, 'host=h' || (user_id % 10) || ';type=' || case when event_type = 'error' then 'fault' else event_type end as labels from events",
)
def _(spark, sf):
    extra = F.when(F.col("event_type") == "error", F.create_map(F.lit(" TYPE"), F.lit("fault"))).otherwise(
        F.create_map(F.lit("host"), event_labels()["host"])
    )
    merged = agg.label_key(dedupe.merge_labels(event_labels(), extra))
    return table(spark, sf, "events").select("event_id", merged.alias("labels"))


@query(
    "rank_latest",
    """select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
    from orders) where rn = 1""",
)
def _(spark, sf):
    out = dedupe.rank_latest(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderdate")
