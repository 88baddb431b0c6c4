"""Structured Streaming versions of the live paths.

Every job takes a streaming DataFrame (files, Kafka, or anything ``readStream`` offers) and returns
a started query or a streaming DataFrame. Side outputs are written per micro-batch into
``<path>/batch=<id>`` with overwrite, so a repeated batch after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import folds
from ..operators.aggregates import index_projection
from ..operators.joins import watchlist
from ..sources.keyindex import exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, max_offsets: int | None = None) -> DataFrame:
    """JSON rows of a Kafka topic; the connector jar comes from the cluster."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def event_time(stream: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Event time with a watermark; watermarks need a zoned timestamp."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def start(out: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Run ``each`` per micro-batch: continuously with ``every``, else once over what is available."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def microbatch(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append arriving rows in micro-batches. Batch size is set on the source, delay by ``every``."""
    return start(stream, checkpoint, batch_writer(path), every=every)


def since(stream: DataFrame, ts: str, start: Column) -> DataFrame:
    """Rows after a time; what was delivered before a restart is not read again, its checkpoint knows."""
    return stream.where(F.col(ts) > start)


def dedupe(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark. State is bounded by time."""
    return event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def latest(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, for update mode."""
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return stream.groupBy(*keys).agg(newest).select(*keys, "__row.*")


def index(stream: DataFrame, ts: str, symbol: str, suffix: str, volume: str, min_volume: float, means: Sequence[str], sums: Sequence[str], width: str = "5 seconds", delay: str = "10 minutes") -> DataFrame:
    """Index projection per time window."""
    timed = event_time(stream, ts, delay).withColumn("window", F.window(ts, width))
    out = index_projection(timed, symbol, suffix, volume, min_volume, means, sums, ["window"])
    return out.withColumn("start", F.col("window.start").cast("timestamp_ntz")).drop("window")


def newest_batch(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The state after an update-mode job: for each key the row of the last batch that touched it."""
    updates = spark.read.parquet(path)
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row")).select(*keys, "__row.*")


def watchlist_filter(stream: DataFrame, symbol: str, listed: Callable[[], DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep listed symbols; the list is read anew for every micro-batch."""

    def each(df: DataFrame, batch: int) -> None:
        watchlist(df, symbol, listed()).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return start(stream, checkpoint, each, every=every)


def late_split(stream: DataFrame, ts: str, delay_seconds: int, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rows older than the newest time of earlier batches minus the delay go to ``late``, the rest to ``on_time``."""

    def each(df: DataFrame, batch: int) -> None:
        # one maximum goes from batch to batch; a batch that is run again reads its predecessor's
        spark, before = df.sparkSession, f"{path}/newest/batch={batch - 1}"
        newest = spark.read.schema("newest timestamp_ntz").parquet(before).first()[0] if exists(spark, before) else None
        df = df.persist()
        limit = F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = F.coalesce(F.col(ts).cast("timestamp_ntz") < limit, F.lit(False))
        df.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        df.where(~late).write.mode("overwrite").parquet(f"{path}/on_time/batch={batch}")
        top = df.agg(F.greatest(F.max(F.col(ts).cast("timestamp_ntz")), F.lit(newest).cast("timestamp_ntz")).alias("newest"))
        top.write.mode("overwrite").parquet(f"{path}/newest/batch={batch}")
        df.unpersist()

    return start(stream, checkpoint, each, every=every)


# Spark joins the frames of several keys to one; texts of pandas' own type become several chunks there, which it can't write, so they are objects


class Heartbeats(StatefulProcessor):
    """Online when a sender is heard after silence, offline when the silence exceeds the timeout.

    A sender that is heard of has one timer. Later beats leave it where it is; when it expires it is set anew if the silence is
    still too short. So a beat costs no look at the timers.
    """

    def __init__(self, timeout_seconds: float):
        self.timeout = timeout_seconds * 1000.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ms double")

    def _rows(self, key, changes) -> pd.DataFrame:
        rows = {"key": [key] * len(changes), "at_ms": [int(a) for a, _ in changes], "state": [s for _, s in changes]}
        return pd.DataFrame(rows).astype({"key": object, "at_ms": "int64", "state": object})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = sorted(float(x) for pdf in rows for x in pdf["at_ms"])
        known = self.seen.get()
        last = None if known is None else known[0]
        changes = []
        for at in beats:
            if last is None:
                changes.append((at, "online"))
            elif at - last > self.timeout:
                changes += [(last + self.timeout, "offline"), (at, "online")]
            last = at if last is None else max(last, at)
        if known is None:
            self.handle.registerTimer(int(last + self.timeout))
        self.seen.update((last,))
        yield self._rows(key[0], changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        due = int(last + self.timeout)
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            yield self._rows(key[0], [])
        else:
            self.seen.clear()
            yield self._rows(key[0], [(due, "offline")])

    def close(self) -> None:
        pass


def heartbeat(stream: DataFrame, key: str, ts: str, timeout_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Changes between online and offline per sender: ``key``, ``at_ms``, ``state``. A beat without a time tells nothing and is left out."""
    beats = event_time(stream.where(F.col(ts).isNotNull()), ts, delay).select(
        F.col(key).cast("string").alias("key"), ts, F.unix_millis(ts).cast("double").alias("at_ms")
    )
    return beats.groupBy("key").transformWithStateInPandas(
        Heartbeats(timeout_seconds), "key string, at_ms bigint, state string", "Append", "EventTime"
    )


class OnlineDetectors(StatefulProcessor):
    """CUSUM, EWMA control and Page-Hinkley fed row by row; the state is the folds' accumulators.

    The warm-up values are kept until there are enough of them, then only their statistics.
    """

    def __init__(self, warm: int, alpha: float, control_l: float, delta: float, limit: float):
        self.warm, self.alpha, self.control = warm, alpha, control_l
        self.level = folds.level_step(alpha)
        self.drift, self.cusum = folds.drift_step(delta, limit), folds.cusum_step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("folds", "n bigint, head array<double>, warm array<double>, acc array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch's rows of a series come in any order; its size is set on the source
        # values of one time are one point, their mean, as in ``series.clean_series``
        batch = pd.concat(list(rows)).groupby("us", as_index=False)["value"].mean()
        if self.state.exists():
            n, head, warm, acc = self.state.get()
            head, warm, acc = list(head), list(warm), list(acc)
        else:
            n, head, warm, acc = 0, [], [], []
        xs, us = batch["value"].to_numpy(dtype=float), batch["us"].to_numpy()
        found = []

        def keep(method, first, scores, direction):
            found.extend((n + first + i, us[first + i], xs[first + i], method, score, direction) for i, score in enumerate(scores) if score > 0)

        opening = 1 if n == 0 else 0
        if opening:
            acc = [float(xs[0]), 0.0, 0.0, 0.0, 0.0]
        (acc[0], acc[1]), (scores,) = self.drift(xs[opening:], n + opening, acc[:2], [])
        keep("page_hinkley", opening, scores, "change")
        waiting = max(self.warm - n, 0)
        if waiting:
            head += xs[:waiting].tolist()
            if len(head) == self.warm:
                mu = sum(head) / self.warm
                warm, acc[4], head = [mu, (sum((h - mu) ** 2 for h in head) / self.warm) ** 0.5], head[-1], []
        if warm and warm[1] >= 1e-12 and waiting < len(xs):
            mu, sd = warm
            later = xs[waiting:]
            (acc[2], acc[3]), (ups, downs) = self.cusum(later, n + waiting, acc[2:4], [mu, 0.5 * sd, 5.0 * sd])
            keep("cusum", waiting, ups, "high")
            keep("cusum", waiting, downs, "low")
            (acc[4],), (levels,) = self.level(later, n + waiting, acc[4:], [])
            limit = self.control * sd * (self.alpha / (2.0 - self.alpha)) ** 0.5
            keep("ewma_control", waiting, [(z - mu) / limit if z - mu > limit else 0.0 for z in levels], "high")
            keep("ewma_control", waiting, [(mu - z) / limit if mu - z > limit else 0.0 for z in levels], "low")
        self.state.update((n + len(xs), [float(h) for h in head], [float(w) for w in warm], [float(a) for a in acc]))
        out = pd.DataFrame(found, columns=["idx", "us", "value", "method", "score", "direction"])
        out.insert(0, "series", key[0])
        yield out.astype({"series": object, "idx": "int64", "us": "int64", "value": "float64", "method": object, "score": "float64", "direction": object})

    def close(self) -> None:
        pass


def anomalies(stream: DataFrame, series: str, ts: str, value: str, warm: int = 30, alpha: float = 0.2, control_l: float = 3.0, delta: float = 0.005, limit: float = 5.0) -> DataFrame:
    """Online detection over rows that arrive in time order from batch to batch; rows of one time come in one batch."""
    rows = stream.select(
        F.col(series).cast("string").alias("series"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(value).cast("double").alias("value"),
    )
    return rows.groupBy("series").transformWithStateInPandas(
        OnlineDetectors(warm, alpha, control_l, delta, limit),
        "series string, idx bigint, us bigint, value double, method string, score double, direction string",
        "Append",
        "None",
    )
