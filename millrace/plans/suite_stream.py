"""Queries: streaming jobs over tables that are delivered in slices of time, with a restart after each slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..session import scratch
from ..streaming import jobs
from .registry import query, table
from .suite_series import ALL_SQL
from .suite_tables import r

DAYS = 8


class Delivery:
    """A table as a file stream; ``next`` delivers one more slice, as many files as Spark writes."""

    def __init__(self, spark, rows: DataFrame, number: str, extra: DataFrame | None = None, at: int = 3):
        self.path, self.rows, self.number, self.extra, self.at = scratch(spark, "stream"), rows.withColumn("__slice", F.expr(number)), number, extra, at
        self.slices = self.rows.agg(F.max("__slice")).first()[0] + 1
        rows.limit(0).write.parquet(self.path)
        self.stream = jobs.file_stream(spark, self.path, rows.schema)

    def next(self, i: int) -> None:
        part = self.rows.where(F.col("__slice") == i).drop("__slice")
        if self.extra is not None and i == self.at:
            part = part.unionByName(self.extra)
        part.write.mode("append").parquet(self.path)

    def run(self, start: Callable) -> None:
        """Start the job anew for each slice; it goes on from its checkpoint."""
        for i in range(self.slices):
            self.next(i)
            start().awaitTermination()


def slice_of(spark, sf) -> str:
    """Slices of eight days from the first day of the events on, so the slices are in time order."""
    first = table(spark, sf, "events").agg(F.min("ts").cast("date").cast("string")).first()[0]
    return f"datediff(ts, date'{first}') div {DAYS}"


def delivered(spark, sf, extra=None, at=3) -> Delivery:
    """The events; ``extra`` rows come with slice ``at``."""
    return Delivery(spark, table(spark, sf, "events"), slice_of(spark, sf), extra, at)


def collected(spark, delivery, out, mode="append"):
    """Run the stream over everything delivered and read what its batches wrote."""
    path, checkpoint = scratch(spark, "out"), scratch(spark, "checkpoint")
    delivery.run(lambda: jobs.start(out, checkpoint, jobs.batch_writer(path), mode))
    return path


def with_rocksdb(run):
    """Stateful processors need the RocksDB state store; the session's own setting is put back."""

    def wrapped(spark, sf):
        key = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(key)
        spark.conf.set(key, jobs.ROCKSDB)
        try:
            return run(spark, sf)
        finally:
            spark.conf.set(key, before)

    return wrapped


@query(
    "st_microbatch",
    """select event_type, count(*) as n, round(sum(value), 4) as total, count(distinct date_diff('day', (select min(ts)::date from events), ts::date) // 8) as batches
    from events group by 1""",
)
def _(spark, sf):
    path, checkpoint, d = scratch(spark, "out"), scratch(spark, "checkpoint"), delivered(spark, sf)
    d.run(lambda: jobs.microbatch(d.stream, path, checkpoint))
    out = spark.read.parquet(path)
    return out.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("batch").alias("batches")
    )


@query("st_dedupe", "select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1")
def _(spark, sf):
    again = table(spark, sf, "events").where(f"{slice_of(spark, sf)} = 3")
    d = delivered(spark, sf, again)
    stored = spark.read.parquet(collected(spark, d, jobs.dedupe(d.stream, "ts", ["event_id"], "30 days")))
    return stored.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("st_latest", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1")
def _(spark, sf):
    d = delivered(spark, sf)
    out = jobs.latest(d.stream.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"])
    state = jobs.newest_batch(spark, collected(spark, d, out, "update"), ["user_id"])
    return state.select("user_id", "event_id", "value")


@query(
    "st_index",
    """select time_bucket(interval 6 hours, ts) as start, count(*) as constituents, round(avg(value), 6) as value from events
    where event_type like '%e' and value >= 1 group by 1""",
)
def _(spark, sf):
    d = delivered(spark, sf)
    rows = d.stream.withColumn("volume", F.col("value"))
    out = jobs.index(rows, "ts", "event_type", "e", "volume", 1.0, ["value"], ["volume"], "6 hours", "2 days")
    state = jobs.newest_batch(spark, collected(spark, d, out, "update"), ["start"])
    return state.select("start", "constituents", r("value"))


@query("st_watchlist", "select event_id, event_type from events where event_type in (select event_type from events where value > 350)")
def _(spark, sf):
    listed = lambda: table(spark, sf, "events").where("value > 350").select("event_type")
    path, checkpoint, d = scratch(spark, "out"), scratch(spark, "checkpoint"), delivered(spark, sf)
    d.run(lambda: jobs.watchlist_filter(d.stream, "event_type", listed, path, checkpoint))
    return spark.read.parquet(path).select("event_id", "event_type")


@query(
    "st_late_split",
    """select 'on_time' as side, count(*) as n, round(sum(value), 4) as total from events
    union all select 'late', count(*), round(sum(value), 4) from events where event_type = 'purchase' and date_diff('day', (select min(ts)::date from events), ts::date) // 8 = 0""",
)
def _(spark, sf):
    late = table(spark, sf, "events").where(f"event_type = 'purchase' and {slice_of(spark, sf)} = 0")
    path, checkpoint, d = scratch(spark, "out"), scratch(spark, "checkpoint"), delivered(spark, sf, late)
    d.run(lambda: jobs.late_split(d.stream, "ts", 3600, path, checkpoint))
    sides = [spark.read.parquet(f"{path}/{s}").select(F.lit(s).alias("side"), "value") for s in ("on_time", "late")]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "st_heartbeat",
    """with g as (select user_id, epoch_us(ts) // 1000 as t, lag(epoch_us(ts) // 1000) over w as before, max(epoch_us(ts) // 1000) over (partition by user_id) as newest,
        max(epoch_us(ts) // 1000) over () as final from events window w as (partition by user_id order by ts)),
    c as (select user_id, t as at_ms, 'online' as state from g where before is null or t - before > 43200000
      union all select user_id, before + 43200000, 'offline' from g where t - before > 43200000
      union all select distinct user_id, newest + 43200000, 'offline' from g where newest + 43200000 < final)
    select user_id::varchar as key, at_ms, state from c""",
)
@with_rocksdb
def _(spark, sf):
    d = delivered(spark, sf)
    out = jobs.heartbeat(d.stream, "user_id", "ts", 12 * 3600, "0 seconds")
    return spark.read.parquet(collected(spark, d, out)).select("key", "at_ms", "state")


@query(
    "st_anomaly",
    f"""with recursive {ALL_SQL} select series, idx, method, round(score, 6) as score, direction from
    (select * from d_cus union all select * from d_ewc union all select * from d_ph)""",
)
@with_rocksdb
def _(spark, sf):
    d = delivered(spark, sf)
    out = jobs.anomalies(d.stream, "event_type", "ts", "value")
    return spark.read.parquet(collected(spark, d, out)).select("series", "idx", "method", r("score"), "direction")


@query(
    "st_since", "select event_type, count(*) as n, min(event_id) as first_id from events where ts > timestamp '2024-01-20' group by 1"
)
def _(spark, sf):
    d = delivered(spark, sf)
    out = jobs.since(d.stream, "ts", F.lit("2024-01-20").cast("timestamp_ntz"))
    stored = spark.read.parquet(collected(spark, d, out))
    return stored.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "join_static_stream",
    """select c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as total from customer
    where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) group by 1""",
)
def _(spark, sf):
    d = Delivery(spark, table(spark, sf, "customer"), "cast(pmod(c_custkey, 3) as int)")
    listed = table(spark, sf, "nation").where("n_regionkey = 1").select("n_name")
    named = d.stream.withColumn("symbol", F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")))
    stored = spark.read.parquet(collected(spark, d, joins.watchlist(named, "symbol", listed)))
    return stored.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
