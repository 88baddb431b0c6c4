"""Queries: whole ingest, report and correlation requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ingest, report
from .registry import query, table
from .suite_docs import payloads
from .suite_tables import r

ORDERS = ingest.Profile(
    id="orders",
    mapping={"k": "dims.order", "p": "measures.price"},
    types={"dims.order": "bigint", "measures.price": "double"},
    rules=[("k", "number", True), ("p", "number", True)],
    schema={"type": "object", "properties": {"p": {"type": "number", "maximum": 400000}}},
    static={"region": "eu"},
)


@query(
    "ingest_profile",
    """with per as (select o_custkey, o_orderkey as k, o_totalprice as p from orders),
    shaped as (select shape, k, p, p <= 400000 as good from per, (values ('array'), ('results'), ('keyed')) s(shape)
      union all select 'single', count(*), max(p), max(p) <= 400000 from per group by o_custkey
      union all select shape, k, p, false from per, (values ('header'), ('hourly')) s(shape)
      union all select 'pairs', k, null, false from per)
    select shape, case when good then 'record' else 'quarantine' end as side, count(*) as n,
      case when good then count(distinct (k, p)) else 0 end as ids, round(sum(p), 2) as total from shaped group by shape, good""",
)
def _(spark, sf):
    good, bad = ingest.run(payloads(spark, sf), "payload", ORDERS)
    price = F.get_json_object("payload", "$.p").cast("double")
    digest = F.unhex(F.substring_index("record_id", ":", -1))  # the ids' hashes are counted as bytes
    sides = good.select("shape", F.lit("record").alias("side"), digest.alias("id"), F.col("data.measures.price").alias("p")).unionByName(
        bad.select("shape", F.lit("quarantine").alias("side"), F.lit(None).cast("binary").alias("id"), price.alias("p"))
    )
    return sides.groupBy("shape", "side").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.round(F.sum("p"), 2).alias("total"))


def _inputs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("timestamp"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("timestamp"))
    return {"orders": o, "customer": c}


SPEC = report.ReportSpec(["key"], {"orders": ["price"], "customer": ["balance", "nation"]})
WIDE_SQL = """w as (select coalesce(c_custkey, o_custkey) as key, c_acctbal, c_nationkey::double as nation, price from customer
  full join (select o_custkey, arg_max(o_totalprice, o_orderkey) as price from orders group by 1) on o_custkey = c_custkey)"""


@query(
    "report_table",
    f"""with {WIDE_SQL} select key, c_acctbal as "customer:balance", nation as "customer:nation", price as "orders:price" from w""",
)
def _(spark, sf):
    return report.report(_inputs(spark, sf), SPEC)


@query(
    "report_correlations",
    f"""with {WIDE_SQL} select 'customer:balance' as a, 'customer:nation' as b, count(*) filter (where c_acctbal is not null and nation is not null) as n, round(corr(c_acctbal, nation), 6) as r from w
    union all select 'customer:balance', 'orders:price', count(*) filter (where c_acctbal is not null and price is not null), round(corr(c_acctbal, price), 6) from w
    union all select 'customer:nation', 'orders:price', count(*) filter (where nation is not null and price is not null), round(corr(nation, price), 6) from w""",
)
def _(spark, sf):
    return report.correlations(_inputs(spark, sf), SPEC).select("a", "b", "n", r("r"))


@query(
    "correlate",
    """with a as (select o_custkey, arg_min(o_totalprice, o_orderkey) as v from orders group by 1)
    select count(*) as n, round(corr(v, c_acctbal), 6) as r, 'Very weak correlation' as label from a join customer on o_custkey = c_custkey""",
)
def _(spark, sf):
    _, stats = report.correlate(
        table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "o_totalprice", "c_acctbal", ["o_orderkey"]
    )
    return stats.select("n", r("r"), "label")
