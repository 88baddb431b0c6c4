"""Registered queries against their SQL on small tables with values that the generated tables have rarely."""

import datetime as dt

import duckdb
import pandas as pd

from millrace.plans import suite
from millrace.streaming import jobs

START = dt.datetime(2024, 1, 1)


def differs(spark, folder, name, events):
    """Rows of the query and of its SQL that the other lacks; ``events`` are (seconds, user, type, value)."""
    frame = pd.DataFrame(
        [(i, START + dt.timedelta(seconds=s), u, kind, v, '{"k": 1}') for i, (s, u, kind, v) in enumerate(events)],
        columns=["event_id", "ts", "user_id", "event_type", "value", "props"],
    )
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(frame, schema).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    out = suite.QUERIES[name](spark, str(folder))
    want = con.sql(f"select {', '.join(out.columns)} from ({suite.ORACLE[name]})").fetchall()
    return set(map(tuple, out.collect())) ^ set(want)


def test_zero_values_of_metrics(spark, tmp_path):
    kinds = ("purchase", "view", "click", "signup", "error", "other")
    assert not differs(spark, tmp_path, "validate_metric", [(i, 1, k, v) for i, (k, v) in enumerate((k, v) for k in kinds for v in (0.0, 2.5, None))])


def test_error_spans_of_no_length_are_left_out(spark, tmp_path):
    assert not differs(spark, tmp_path, "normalize_spans", [(i, i % 2, k, v) for i, (k, v) in enumerate((k, v) for k in ("view", "error", "click") for v in (0.0, 3.25))])


def test_equal_times_of_a_streamed_series_are_averaged(spark, tmp_path):
    # two and three values at one time, and a jump that the detectors report
    events = [(i // 2 if i < 60 else i // 3 + 10, 1, "view", 10.0 + i % 7 + 40 * (i > 150)) for i in range(240)]
    assert not differs(spark, tmp_path, "st_anomaly", events)


def test_heartbeats_without_a_time_and_over_many_slices(spark, tmp_path):
    day = 86_400
    beats = [(0, 1), (3_600, 1), (day, 1), (9 * day, 1), (9 * day + 3_600, 1), (17 * day, 2), (17 * day, 1), (17 * day + 43_200, 1), (25 * day, 3)]
    rows = [(s + i / 1000, u, "view", 1.0) for i, (s, u) in enumerate(beats)]
    assert not differs(spark, tmp_path, "st_heartbeat", rows)


def test_a_heartbeat_without_a_time_is_left_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", START), ("a", None), ("b", None)], "user string, ts timestamp_ntz")
    rows.write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        out = jobs.heartbeat(jobs.file_stream(spark, f"{tmp_path}/in", rows.schema), "user", "ts", 60)
        jobs.start(out, f"{tmp_path}/checkpoint", jobs.batch_writer(f"{tmp_path}/out")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert [(r["key"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", "online")]
