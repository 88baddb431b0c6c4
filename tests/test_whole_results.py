"""Nothing is lost in silence: NULL keys, unreadable rows, long inputs, colliding keys, hot values."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, text
from millrace.operators import aggregates, audit, compliance, contracts, documents, features, forecast, joins, positions, telemetry
from millrace.plans import report
from millrace.sources import readers, sinks


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in ("a", None) for v in range(1, 6)], "k string, v double")
    picked = {r["k"]: r["percentile"] for r in aggregates.percentile_nearest(rows, ["k"], "v", [50]).collect()}
    assert picked == {"a": 3.0, None: 3.0}
    stats = {r["k"]: (r["count"], r["median"], r["q1"], r["q3"]) for r in aggregates.dist_stats(rows, ["k"], "v").collect()}
    assert stats == {"a": (5, 3.0, 1.5, 4.5), None: (5, 3.0, 1.5, 4.5)}
    placed = positions.with_position(rows, ["k"], ["v"])
    assert sorted(r["idx"] for r in placed.where("k is null").collect()) == [0, 1, 2, 3, 4]
    summed = positions.with_running(placed, ["k"], {"total": F.col("v")}, block_rows=2)
    assert [r["total"] for r in summed.where("k is null").orderBy("idx").collect()] == [1.0, 3.0, 6.0, 10.0, 15.0]


def test_asof_and_chain_keep_null_keys(spark):
    left = spark.createDataFrame([(None, 5, "x"), ("a", 5, "y")], "k string, ts int, name string")
    right = spark.createDataFrame([(None, 1, 7.0), ("a", 9, 8.0)], "k string, ts int, v double")
    out = {r["name"]: r["v"] for r in joins.join_asof(left, right, ["k"], "ts", "v").collect()}
    assert out == {"x": 7.0, "y": None}
    log = spark.createDataFrame([(None, 1, "p"), (None, 2, "q"), ("t", 1, "r")], "tenant string, n int, body string")
    chained = audit.chain_build(log, ["tenant"], ["n"], F.col("body"))
    got = {(r["tenant"], r["n"]): (r["prev_hash"], r["hash"]) for r in chained.collect()}
    first = hashlib.sha256(b"GENESIS\np").hexdigest()
    assert len(got) == 3 and got[None, 1] == ("GENESIS", first) and got[None, 2][0] == first


def test_hot_values_are_single_rows(spark):
    values = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("double").alias("v"))
    counted = aggregates._through(values, ["k"], "v")
    assert counted.groupBy("v").count().agg(F.max("count")).first()[0] == 1
    assert counted.agg(F.max("through"), F.max("c")).first() == (20_000, 18_000)
    assert aggregates.percentile_nearest(values, ["k"], "v", [50]).first()["percentile"] == 7.0


def test_small_sides_do_not_move_the_facts(spark):
    facts = spark.range(1000).select((F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("v"))
    plan = aggregates.outliers_z(facts, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    physical = aggregates.outliers_z(facts, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical


def test_unreadable_documents_are_counted_and_returned(spark, tmp_path):
    rows = spark.createDataFrame([('{"a": 1}', "p", 1), ("{broken", "p", 2), ("also broken", "p", 3)], "doc string, profile_id string, seq int")
    rows = rows.withColumn("record_id", hashing.record_id(F.col("doc")))
    counts = sinks.insert_records(rows, str(tmp_path / "records"), ["seq"]).first()
    assert (counts["inserted"], counts["deduped"], counts["rejected"]) == (1, 0, 2)
    assert {r["reason"] for r in sinks.rejected_records(rows).collect()} == {"no_record_id"}
    cleaned = documents.drop_nulls(rows, "doc")
    assert {r["seq"]: r["problem"] for r in cleaned.collect()} == {1: None, 2: "parse_error", 3: "parse_error"}


def test_series_payloads_report_what_they_reject(spark):
    key = '{"tenant_id":"t","namespace":"n","metric":"m","entity_type":"e","entity_id":"1"}'
    good = f'{{"series":[{{"key":{key},"points":[{{"ts":"2024-01-01T00:00:00Z","value":1.5}},{{"ts":"soon","value":2}},{{"ts":"2024-01-01T00:00:00Z"}}]}}]}}'
    payloads = spark.createDataFrame([(good,), ('{"extra": 1}',), ("[1]",), ("{",)], "value string")
    points, rejected = readers.split_ts_payload(payloads)
    assert [(r["entity_id"], r["value"]) for r in points.collect()] == [("1", 1.5)]
    assert sorted(r["reason"] for r in rejected.collect()) == ["bad_time", "bad_value", "not_an_object", "not_an_object", "unknown_field"]


def test_limits_are_the_callers(spark):
    rows = spark.range(1500).select(F.col("id"), F.timestamp_seconds("id").alias("ts"))
    assert readers.scan(rows, {}, "ts", "id", 1200).count() == 1200
    assert readers.scan(rows, {}, "ts", "id", None).count() == 1500
    assert features.filter_since(rows, F.lit(True), "ts", F.timestamp_seconds(F.lit(-1)), "id", None).count() == 1500
    page = features.range_scan(rows, F.lit(True), "ts", F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(9999)), ["id"], None)
    assert page.where("not truncated").count() == 1500
    grid = spark.range(100).select(F.col("id").alias("x"), F.lit(1).alias("y"), F.col("id").alias("v"))
    assert aggregates.heat_grid(grid, "x", "y", "v", ["v"]).count() == 100
    assert aggregates.heat_grid(grid, "x", "y", "v", ["v"], max_x=60).count() == 60
    long_error = spark.range(1).select(text.redact_secrets(F.concat(F.repeat(F.lit("e "), 3000), F.lit("token=abc"))).alias("t")).first()["t"]
    assert len(long_error) > 6000 and long_error.endswith("token=[REDACTED]")
    items = "".join(f"<item><title>t{i}</title><link>l{i}</link></item>" for i in range(30))
    feed = spark.createDataFrame([(1, f"<rss><channel>{items}</channel></rss>")], "id int, xml string")
    assert readers.read_feeds(feed, "xml").count() == 30


def test_labels_are_kept_whole_and_never_collide(spark):
    labels = spark.createDataFrame([({f"n{i}": "v" * 300 for i in range(40)},)], "m map<string,string>")
    out = labels.select(telemetry.normalize_labels(F.col("m")).alias("m"), telemetry.label_problems(F.col("m")).alias("p")).first()
    assert len(out["m"]) == 40 and set(out["m"].values()) == {"v" * 300}
    assert "many_pairs" in out["p"] and "long_value:n0" in out["p"]
    rows = spark.createDataFrame([({"a": "1;b=2"}, 1.0), ({"a": "1", "b": "2"}, 2.0)], "m map<string,string>, v double")
    assert sorted(r["total"] for r in aggregates.counter_sum(rows, F.col("m"), "v").collect()) == [1.0, 2.0]


def test_identifiers_tell_null_parts_apart(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    x, y = F.col("x"), F.col("y")
    ids = [
        hashing.event_id(x, y, F.lit("t"), F.lit("p")),
        hashing.idempotency_key(F.lit("t"), F.lit("s"), [x, y]),
        documents.partition_key(x, y, F.lit("2024-01-01").cast("timestamp")),
        audit.observation_id([x, y], F.create_map(F.lit("k"), F.lit("v"))),
    ]
    for ident in ids:
        assert rows.select(ident.alias("i")).distinct().count() == 2


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


@pytest.mark.parametrize("value", ["", "a", "t1|job", "ünïcode|ü", "x" * 200])
def test_fnv_hash(spark, value):
    got = spark.createDataFrame([(value,)], "v string").select(hashing.fnv1a_64(F.col("v")).alias("h")).first()["h"]
    assert int(got) == fnv(value.encode())


def test_shards_ignore_case_and_blanks(spark):
    rows = spark.createDataFrame([(" T1", "Job"), ("t1", "job ")], "t string, j string")
    shards = {r["s"] for r in rows.select(hashing.shard_for(F.col("t"), F.col("j"), 16).alias("s")).collect()}
    assert shards == {fnv(b"t1|job") % 16}


def test_measure_names_come_back_as_they_are(spark):
    a = spark.createDataFrame([(k, float(k), float(k * k), k) for k in range(5)], "key int, net__value double, y double, timestamp int")
    spec = report.ReportSpec(["key"], {"x": ["net__value", "y"]})
    assert report.correlations({"x": a}, spec).select("a", "b").first() == ("x:net__value", "x:y")


def test_repeated_span_ids_multiply_nothing(spark):
    spans = spark.createDataFrame(
        [("t", "1", None, "op", 0, 4), ("t", "1", None, "op", 0, 6), ("t", "2", "1", "op", 1, 3)],
        "trace_id string, span_id string, parent_id string, operation string, s long, e long",
    ).withColumns({"start": F.timestamp_seconds("s"), "end": F.timestamp_seconds("e")})
    good, bad = telemetry.normalize_spans(spans)
    assert good.count() == 3 and bad.count() == 0
    assert good.where("span_id = '2'").first()["parent_seconds"] == 6.0


def test_heads_tell_cut_and_rechained_logs(spark):
    log = spark.createDataFrame([(t, n, f"{t}{n}") for t in "abcd" for n in range(3)] + [(None, 0, "x")], "tenant string, n int, body string")
    build = lambda df: audit.chain_build(df, ["tenant"], ["n"], F.col("body")).drop("idx")
    chained = build(log)
    heads = audit.chain_heads(chained, ["tenant"], ["n"])
    again = build(log.where("tenant = 'b'").withColumn("body", F.concat("body", F.lit("!"))))
    now = chained.where("tenant = 'a' and n < 2").unionByName(again).unionByName(chained.where("tenant = 'd' or tenant is null"))
    now = now.unionByName(build(log.where("tenant = 'd'").withColumn("tenant", F.lit("new"))))
    assert audit.chain_verify(now, ["tenant"], ["n"], F.col("body")).where("tenant = 'a'").count() == 0
    found = {r["tenant"]: r["problems"] for r in audit.verify_heads(now, ["tenant"], ["n"], heads).collect()}
    assert found == {"a": ["cut"], "b": ["head"], "c": ["missing"], "new": ["unknown"]}


def test_schema_keywords_are_checked_or_raise(spark):
    docs_ = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1, "B": 2}'), (3, "{}"), (4, "[1]")], "n int, doc string").withColumn("v", F.try_parse_json("doc"))
    schema = {"title": "t", "minProperties": 1, "maxProperties": 1, "propertyNames": {"pattern": "^[a-z]+$"}}
    got = {r["n"]: r["p"] for r in docs_.select("n", F.sort_array(contracts.validate_contract(schema, F.col("v"))).alias("p")).collect()}
    assert got == {1: [], 2: ["$:maxProperties", "$:propertyNames"], 3: ["$:minProperties"], 4: []}
    with pytest.raises(ValueError, match="uniqueItems"):
        contracts.validate_contract({"properties": {"x": {"uniqueItems": True}}}, F.col("v"))


def test_rules_with_outcomes_and_switches(spark):
    rows = spark.createDataFrame([("Pay  now", "FAILURE"), ("pay", "ok"), ("pay", None)], "action string, outcome string")
    rules = [joins.ControlRule("pay", ("fraud",), ("failure",)), ("pay", ("money",)), joins.ControlRule("now", ("off",), enabled=False)]
    assert [r["controls"] for r in joins.rules_join(rows, "action", rules, outcome="outcome").collect()] == [["fraud", "money"], ["money"], ["money"]]
    with pytest.raises(ValueError):
        joins.rules_join(rows, "action", rules)


def test_redaction_rules(spark):
    rows = spark.createDataFrame([(("x", ("y",)), [("1", "a"), (None, "b")], "m")], "s struct<a:string,i:struct<b:string>>, l array<struct<n:string,k:string>>, t string")
    rules = [compliance.Redaction("s.i.b", "<b>"), compliance.Redaction("l[].n", "#"), compliance.Redaction("t", "?", enabled=False), "s.a", "s.none", "absent"]
    out = compliance.redact(rows, rules).first()
    assert out["s"]["i"]["b"] == "<b>" and out["s"]["a"] == "[REDACTED]" and out["t"] == "m"
    assert [tuple(x) for x in out["l"]] == [("#", "a"), (None, "b")] and out["redacted_paths"] == ["l[].n", "s.a", "s.i.b"]


def test_cursors_belong_to_their_query():
    cursor = features.make_cursor({"tenant": "a"}, "2024-01-01", 7)
    assert features.read_cursor(cursor, {"tenant": "a"}) == ("2024-01-01", 7)
    for wrong, query in ((cursor, {"tenant": "b"}), ("bm90IGpzb24=", {}), ("%%%", {})):
        with pytest.raises(ValueError):
            features.read_cursor(wrong, query)


def test_backtest_takes_a_model_function(spark):
    points = spark.createDataFrame([("k", i, float(i)) for i in range(20)], "k string, idx long, value double")
    cfg = forecast.ForecastConfig(horizon=1)
    last = lambda df, keys, c: df.withColumn("path", F.array("value"))
    assert {r["mae"] for r in forecast.backtest(points, ["k"], last, cfg).collect()} == {1.0}


def test_tables_have_the_union_of_all_fields(spark):
    docs_ = ['{"b": 1, "a": "x"}', '{"A": null, "k": {"z": [1]}}', "[1]", "{broken", None]
    rows = spark.createDataFrame(list(enumerate(docs_)), "k int, doc string").repartition(3)
    table = documents.rows_to_table(rows, "doc", ["k"])
    assert table.columns == ["k", "A", "a_2", "b", "k_2"]  # names that Spark would take for the same are numbered
    assert sorted(tuple(r) for r in table.collect())[:2] == [(0, None, "x", "1", None), (1, None, None, None, '{"z":[1]}')]
    assert documents.rows_to_table(rows, "doc", ["k"], widest=3).columns == ["k", "fields"]
    named = documents.rows_to_table(rows, "doc", ["k"], ["b", "none"]).where("k = 0").first()
    assert (named["b"], named["none"], named["others"]) == ("1", None, {"a": "x"})
    assert documents.rows_to_table(rows.limit(0), "doc", ["k"]).columns == ["k"]


def test_eviction_drops_the_oldest(spark):
    rng = random.Random(2)
    hours = [f"2024-01-01 {rng.choice([3, 3, 3, 7, 11]):02d}:{rng.randrange(3):02d}:00" for _ in range(300)] + ["soon", None, "2024-01-01 03:00:00"]
    rows = [(f"t{i % 3}", i // 2, ts) for i, ts in enumerate(hours)]
    log = spark.createDataFrame(rows, "tenant string, id int, ts string").repartition(4)

    def age(r):
        return (r[2] if r[2] and r[2] != "soon" else "1970", r[0], r[1])

    for most in (1, 37, 150, 302, 303, 500):
        kept = audit.with_evicted(log, most, "ts", ["tenant", "id"]).where("not evicted").drop("evicted")
        want = sorted(rows, key=age)[-most:]
        assert sorted(map(age, kept.collect())) == sorted(map(age, want)), most
    assert audit.with_evicted(log, 0, "ts", ["tenant", "id"]).where("evicted").isEmpty()
    more = spark.createDataFrame([("t9", 1, "2025-01-01 00:00:00"), ("t9", 1, "2025-01-01 00:00:00")], log.schema)
    after = audit.append_bounded(log, more, ["tenant", "id"], ["ts"], 10, "ts")
    assert after.count() == 10 and after.where("tenant = 't9'").count() == 1


def test_joined_parts_never_collide(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a/b", "c"), ("a", "b/c"), ("a%2Fb", "c"), ("1:a", "c")], "x string, y string")
    x, y, day = F.col("x"), F.col("y"), F.lit("2024-01-01").cast("timestamp")
    made = rows.select(
        hashing.event_id(x, y, F.lit("t"), F.lit("p")).alias("e"),
        hashing.event_id(x, y, F.lit("t"), F.lit("p"), plain=True).alias("old"),
        documents.partition_key(x, y, day).alias("k"),
        hashing.idempotency_key_of_map(x, F.lit("s"), F.create_map(x, y)).alias("m"),
    ).collect()
    assert len({r["e"] for r in made}) == len({r["k"] for r in made}) == len({r["m"] for r in made}) == 6
    assert made[0]["old"] == made[1]["old"]
    same = spark.createDataFrame([({" B": "1", "a": None, "": "x"},), ({"A ": None, "b": "1"},)], "m map<string,string>")
    keys = {r["k"] for r in same.select(hashing.idempotency_key_of_map(F.lit(" ACME!"), F.lit(" Pay "), F.col("m")).alias("k")).collect()}
    assert len(keys) == 1 and keys.pop().startswith("v1:acme:pay:")
    assert spark.range(1).select(hashing.idempotency_key(F.lit(None).cast("string"), F.lit("a b"), [F.lit("p")])).first()[0] is None


def test_chains_of_many_pieces_need_no_python(spark):
    texts = [None if i == 300 else f"é{i}" for i in range(700)]
    log = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "tenant string, n int, body string")
    chained = audit.chain_build(log, ["tenant"], ["n"], F.col("body"), block=400)
    previous = "GENESIS"
    for r in chained.orderBy("n").collect():
        now = hashlib.sha256(f"{previous}\n{hashing.ABSENT if r['body'] is None else r['body']}".encode()).hexdigest()
        assert (r["prev_hash"], r["hash"]) == (previous, now)
        previous = now
    assert "Python" not in chained._jdf.queryExecution().executedPlan().toString()
    assert audit.chain_verify(chained.drop("idx"), ["tenant"], ["n"], F.col("body")).count() == 0
    assert [r["n"] for r in audit.chain_verify(chained.drop("idx").withColumn("body", F.coalesce("body", F.lit("x"))), ["tenant"], ["n"], F.col("body")).collect()] == [300]
