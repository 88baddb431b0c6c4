"""Documents, joins, audit chains, sinks and streams on small fixtures."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, text, variants
from millrace.operators import aggregates, audit, compliance, contracts, dedupe, documents, joins
from millrace.plans import report
from millrace.sources import keyindex, readers, sinks
from millrace.streaming import jobs


def one(spark, column, value, type_="string"):
    return spark.createDataFrame([(value,)], f"c {type_}").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [("$1,234.5", "1234.50"), ("-$3", "-3.00"), ("$-3.10", "-3.10"), ("(7.25)", "-7.25"), ("abc", None), ("1.2.3", "1.23")],
)
def test_money_keeps_the_sign(spark, raw, want):
    assert one(spark, text.money, raw) == want


def test_text_helpers(spark):
    assert one(spark, text.clean_text, "  a \t b ") == "a b"
    assert one(spark, text.clean_text, " N/A ") is None
    assert one(spark, text.phone_us, "1 (555) 123-4567") == "+15551234567"
    assert one(spark, text.date_iso, "Jan 2, 2024") == "2024-01-02"
    assert one(spark, text.to_number, "1,234.5") == 1234.5
    assert one(spark, text.redact_secrets, "failed: Bearer abc.def now") == "failed: Bearer [REDACTED] now"


def test_canonical_json_sorts_every_level(spark):
    got = one(spark, hashing.canonical_json, '{"b": 2, "a": {"d": 4, "c": 3}}')
    assert got == '{"a":{"c":3,"d":4},"b":2}'


def test_hmac_matches_python(spark):
    for secret in (b"k", b"x" * 100):
        got = one(spark, lambda c, s=secret: hashing.hmac_sha256(s, c), "subject é")
        assert got == hmac.new(secret, "subject é".encode(), hashlib.sha256).hexdigest()


def test_expand_mixed_shapes_and_broken_payloads(spark):
    payloads = [
        '{"prices": [[1, 10.5], [2, 11]], "market_caps": [[1, 100]], "total_volumes": []}',
        '{"bitcoin": {"usd": 1}, "ether": {"usd": 2}}',
        '{"lat": 1, "hourly": {"time": ["a", "b"], "t": [1, 2], "short": [1]}}',
        '[["NAME", "pop"], ["x", "1"], ["y", "2"]]',
        '[{"a": 1}, 5]',
        '{"RESULTS": [{"a": 1}]}',
        '{"a": 1}',
        "not json",
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    rows = documents.expand_records(df, "payload").select("id", "pos", F.to_json("record").alias("r")).orderBy("id", "pos").collect()
    got = {i: [json.loads(r["r"]) for r in rows if r["id"] == i] for i in range(8)}
    assert len(got[0]) == 1 and got[0][0]["price"] == 10.5 and got[0][0]["market_cap"] == 100
    assert got[1] == [{"crypto_id": "bitcoin", "usd": 1}, {"crypto_id": "ether", "usd": 2}]
    assert got[2] == [{"t": 1, "time": "a"}, {"t": 2, "time": "b"}]
    assert got[3] == [{"NAME": "x", "pop": "1"}, {"NAME": "y", "pop": "2"}]
    assert got[4] == [{"a": 1}, 5] and got[5] == [{"a": 1}] and got[6] == [{"a": 1}] and got[7] == []


def test_numeric_keys_do_not_collapse(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 5.0), (4, None)], "id int, k double")
    assert {r["id"] for r in dedupe.dedupe_by_path(df, F.col("k"), ["id"]).collect()} == {1, 2}


def test_dedupe_is_idempotent_and_compaction_clips(spark):
    mk = lambda rows: spark.createDataFrame(rows, "series string, ts string, value double, seq int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    a = mk([("x", "2024-01-01 00:00:00", 1.0, 1), ("x", "2024-01-01 00:01:00", 2.0, 2), ("y", "2024-01-01 00:00:00", 9.0, 3)])
    b = mk([("x", "2024-01-01 00:00:00", 5.0, 4), ("y", "2024-01-02 00:00:00", 7.0, 5)])
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    points, info = dedupe.compact_series([a, b], ["series"], "ts", lit("2024-01-01"), lit("2024-01-02"), ["seq"])
    assert {(r["series"], r["value"]) for r in points.collect()} == {("x", 1.0), ("x", 2.0), ("y", 9.0)}
    assert {r["series"]: (r["input_points"], r["duplicates"], r["outside"]) for r in info.collect()} == {"x": (3, 1, 0), "y": (2, 0, 1)}
    once = dedupe.dedupe_points(a.unionByName(b), ["series"], "ts", ["seq"])
    assert once.exceptAll(dedupe.dedupe_points(once, ["series"], "ts", ["seq"])).count() == 0


def test_join_keys_with_bars_and_newest_wins(spark):
    a = spark.createDataFrame([("a|b", "c", 1.0, 1), ("a|b", "c", 2.0, 2), ("a", None, 3.0, 1)], "k1 string, k2 string, m double, t int")
    b = spark.createDataFrame([("a", "b|c", 5.0, 1)], "k1 string, k2 string, n double, t int")
    out = joins.join_multi_full({"A": (a, ["m"]), "B": (b, ["n"])}, ["k1", "k2"], "t")
    assert {(r["k1"], r["k2"], r["A:m"], r["B:n"]) for r in out.collect()} == {("a|b", "c", 2.0, None), ("a", "b|c", None, 5.0)}


def test_pearson_edges_and_pvalue(spark):
    rows = [("line", float(i), 2.0 * i + 1) for i in range(50)] + [("flat", float(i), 3.0) for i in range(5)] + [("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {r["g"]: r for r in aggregates.with_pvalue(aggregates.pearson(df, "a", "b", ["g"])).collect()}
    assert got["line"]["r"] == pytest.approx(1.0) and got["line"]["p_value"] == pytest.approx(0.0)
    assert got["flat"]["r"] == 0.0 and got["flat"]["p_value"] == pytest.approx(1.0)
    assert got["one"]["p_value"] == 1.0


def test_asof_across_blocks(spark):
    left = spark.createDataFrame([("u", i, i) for i in range(0, 40, 3)], "k string, ts int, id int")
    right = spark.createDataFrame([("u", i, float(i)) for i in (4, 5, 21)], "k string, ts int, v double")
    got = {r["id"]: r["v"] for r in joins.join_asof(left, right, ["k"], "ts", "v", block_rows=2).collect()}
    assert got == {i: (21.0 if i >= 21 else 5.0 if i >= 5 else 4.0 if i >= 4 else None) for i in range(0, 40, 3)}


@pytest.mark.parametrize("block", [3, 1000])
def test_chain_is_sequential_and_tamper_evident(spark, block):
    rows = [("t1", i, f"e{i}") for i in range(20)] + [("t2", i, f"f{i}") for i in range(2)]
    df = spark.createDataFrame(rows, "tenant string, n int, body string")
    chain = audit.chain_build(df, ["tenant"], ["n"], F.col("body"), block=block)
    got = {(r["tenant"], r["n"]): r["hash"] for r in chain.collect()}
    previous = "GENESIS"
    for i in range(20):
        previous = hashlib.sha256(f"{previous}\ne{i}".encode()).hexdigest()
        assert got[("t1", i)] == previous
    chain = chain.drop("idx")
    assert audit.chain_verify(chain, ["tenant"], ["n"], F.col("body")).count() == 0
    edited = chain.withColumn("body", F.when((F.col("tenant") == "t1") & (F.col("n") == 7), "x").otherwise(F.col("body")))
    assert [r["n"] for r in audit.chain_verify(edited, ["tenant"], ["n"], F.col("body")).collect()] == [7]
    cut = chain.where("not (tenant = 't1' and n = 7)")
    assert [r["problems"] for r in audit.chain_verify(cut, ["tenant"], ["n"], F.col("body")).collect()] == [["link"]]


def test_contract_keywords(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"], "multipleOf": 5}, "l": {"items": {"type": "string"}, "maxItems": 2}}, "additionalProperties": {"type": "boolean"}}
    cases = {
        '{"a": 10}': [],
        '{"a": null, "x": true}': [],
        '{"a": 3}': ["$.a:multipleOf"],
        '{"l": ["x", 1, "y"]}': ["$.a:required", "$.l:maxItems", "$.l[]:type"],
        '{"a": 5, "x": 1}': ["$.*:type"],
        "[]": ["$:type"],
    }
    for doc, want in cases.items():
        assert sorted(one(spark, lambda c: contracts.validate_contract(schema, F.parse_json(c)), doc)) == want


def test_retention_needs_now_and_keeps_bad_times(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2023-01-01",), ("",), ("soon",)], "ts string")
    out = [r["reason"] for r in compliance.retention(df, "ts", F.lit("2024-02-01").cast("timestamp"), 90).collect()]
    assert out == ["keep:within_window", "expired:outside_window", "keep:missing_ts", "keep:invalid_ts"]


def test_report_id_ignores_order():
    a = report.ReportSpec(["k", "j"], {"x": ["b", "a"], "y": ["c"]})
    b = report.ReportSpec(["j", "k"], {"y": ["c"], "x": ["a", "b"]})
    assert a.id == b.id


def test_payload_files_and_manifest(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    (tmp_path / "bad.json").write_text("{")
    good, bad = readers.read_json_batch(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (1, 1)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in sinks.manifest(spark, str(tmp_path)).collect()}
    assert rows["bad.json"]["bytes"] == 1 and rows["bad.json"]["sha256"] == hashlib.sha256(b"{").hexdigest()


def test_series_payload_is_strict(spark, tmp_path):
    doc = {"meta": {"s": "x"}, "series": [{"key": {"tenant_id": "t", "metric": "m"}, "points": [{"ts": "2024-01-01T00:00:00.000001Z", "value": 1.5}, {"ts": "bad", "value": 1}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "surprise": 1}))
    points, rejected = readers.read_ts_payload(spark, str(tmp_path))
    rows = points.collect()
    assert sorted(r["reason"] for r in rejected.collect()) == ["bad_time", "unknown_field"]
    assert len(rows) == 1 and rows[0]["metric"] == "m" and rows[0]["ts"].microsecond == 1


def test_database_and_object_options(spark):
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "http://x", "t")
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:x", "t", partition_column="id")
    with pytest.raises(ValueError):
        readers.read_object(spark, "s3a://b/x", "xlsx")


def test_second_insert_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([("r1", "p", 1), ("r1", "p", 2), ("r2", "p", 3)], "record_id string, profile_id string, n int")
    path = str(tmp_path / "records")
    assert tuple(sinks.insert_records(df, path, ["n"]).first()) == (2, 1, 0)
    assert tuple(sinks.insert_records(df, path, ["n"]).first()) == (0, 3, 0)


def test_inserts_read_what_may_hold_their_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyindex, "PER_CELL", 50)
    monkeypatch.setattr(keyindex, "CELLS", 2)
    path, key = str(tmp_path / "records"), sinks.RECORD_KEY
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('r', id) as record_id", "concat('p', id % 3) as profile_id", "id as n")
    looked = []
    for lo, hi in ((0, 1000), (1000, 5000), (5000, 20_000)):
        assert tuple(sinks.insert_records(rows(lo, hi), path, ["n"]).first()) == (hi - lo, 0, 0)
        few = rows(500, 505).unionByName(rows(90_000, 90_005))
        found = keyindex.candidates(few.select(*key), path, key)
        looked.append(found.count())
        assert few.join(found.select(*key), key, "left_semi").count() == 5  # no key is missed
    assert looked[-1] < 20_000 / 10 and looked[-1] <= looked[0] + 1000, looked  # rows read do not follow the table
    again = rows(0, 20_000).unionByName(rows(30_000, 30_010)).unionByName(spark.createDataFrame([(None, "p", 1)], "record_id string, profile_id string, n long"))
    assert tuple(sinks.insert_records(again, path, ["n"]).first()) == (10, 20_000, 1)
    assert sorted(r["n"] for r in sinks.stored_records(spark, path).collect()) == [*range(20_000), *range(30_000, 30_010)]
    assert sinks.stored_records(spark, path).columns == ["record_id", "profile_id", "n"]


def test_an_index_without_its_rows_is_skipped(spark, tmp_path):
    path = str(tmp_path / "records")
    df = spark.createDataFrame([("r1", "", 1)], "record_id string, profile_id string, n int")
    sinks.insert_records(df, path, ["n"])
    stale = spark.createDataFrame([("gone", 1, 0, bytearray(b"\xff" * 4096))], "batch string, cells long, cell long, bitmap binary")
    stale.write.mode("append").parquet(f"{path}/{keyindex.INDEX}")
    assert tuple(sinks.insert_records(df.unionByName(df.selectExpr("'r2' as record_id", "profile_id", "n")), path, ["n"]).first()) == (1, 1, 0)


def test_stream_restart_has_no_repeats(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    rows = spark.range(10).selectExpr("id", "timestamp'2024-01-01' + make_dt_interval(0, 0, id) as ts")
    for part in (rows.where("id < 6"), rows.where("id >= 4")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = jobs.dedupe(jobs.file_stream(spark, src, rows.schema), "ts", ["id"], "1 day")
        jobs.start(stream, ckpt, jobs.batch_writer(out)).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(10))


def test_manifest_of_many_folders_is_written_and_listed_by_few_tasks(spark, tmp_path):
    path = str(tmp_path / "manifest")
    sinks.write_texts(spark.range(200).selectExpr("id", "concat('t', id) as text"), path, "id", "text")
    sc, found = spark.sparkContext, []
    sc.setJobGroup("listing", "listing")
    try:
        found = sinks.manifest(spark, path, "*.txt").select("path", "bytes").collect()
        jobs = sc.statusTracker().getJobIdsForGroup("listing")
        stages = [s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
        tasks = [sc.statusTracker().getStageInfo(s).numTasks for s in stages]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["path"].split("/")[-2], r["bytes"]) for r in found) == sorted((f"id={i}", len(f"t{i}") + 1) for i in range(200))
    assert max(tasks) <= 4 * sc.defaultParallelism  # 200 before: a task for each folder
    assert spark.conf.get(sinks.LISTING) == "10000"
