"""Ingest: one pass over the payloads, with every unreadable and quarantined text kept."""

from pyspark.sql import functions as F

from millrace.functions import hashing, variants
from millrace.operators import contracts, documents
from millrace.plans import ingest

PROFILE = ingest.Profile(
    id="o",
    mapping={"k": "dims.k", "p": "measures.p"},
    types={"dims.k": "bigint", "measures.p": "double"},
    rules=[("k", "number", True), ("z", "string", False)],
    schema={"type": "object", "properties": {"p": {"type": "number", "maximum": 10}}},
)
PAYLOADS = ['[{"k": 1, "p": 2.5}, {"k": "1", "p": 11}, 5]', "[]", "no json", None, '{"k": 2, "p": 10}', "[1,"]


def test_ingest_reads_payloads_once_and_loses_none(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text

    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "id int, body string").withColumn("body", seen.asNondeterministic()("body"))
    good, bad = ingest.run(df, "body", PROFILE)
    assert [(r["id"], r["pos"], r["data"]["dims"]["k"], r["data"]["measures"]["p"]) for r in good.orderBy("id", "pos").collect()] == [(0, 0, 1, 2.5), (4, 0, 2, 10.0)]
    assert good.columns == ["id", "pos", "data", "profile_id", "record_id"] and bad.columns == ["id", "pos", "violations", "reason", "payload"]
    rows = {(r["id"], r["pos"]): (r["reason"], r["violations"], r["payload"]) for r in bad.collect()}
    assert rows == {
        (0, 1): ("schema_violation", ["type_mismatch:k:number:string", "$.p:maximum"], '{"k":"1","p":11}'),
        (0, 2): ("schema_violation", ["missing:k", "$:type", "not_an_object"], "5"),
        (2, None): ("parse_error", None, "no json"),
        (3, None): ("parse_error", None, None),
        (5, None): ("parse_error", None, "[1,"),
    }
    assert reads.value == len(PAYLOADS)  # twice as many before: once for the records, once for what is unreadable


def analyzed(df, word: str) -> int:
    return df._jdf.queryExecution().analyzed().toString().count(word)


def test_checks_read_a_value_once(spark):
    """A rule's expression looked for the type 18 times before."""
    df = spark.sql("""select parse_json('{"k": 1}') as v""")
    rule = df.select(contracts.validate_rules(F.col("v"), [("k", "number", True)]).alias("x"))
    contract = df.select(contracts.validate_contract(PROFILE.schema, F.col("v")).alias("x"))
    assert analyzed(rule, "schema_of_variant") == 1 and analyzed(contract, "schema_of_variant") == 2


def test_let_builds_no_array(spark):
    df = spark.range(1).select(variants.let(F.col("id") + 1, lambda x: x * x + x).alias("x"))
    assert df.first()[0] == 2 and analyzed(df, "transform(") == 0


def test_expansion_keeps_odd_shapes(spark):
    cases = {
        '{"b": {"crypto_id": "z", "x": 1e3}, "a": {}}': ['{"crypto_id":"a"}', '{"crypto_id":"b","x":1000.0}'],
        '{"\\uffee": {"k": 2}, "\\ud83d\\ude00": {"k": 1}}': ['{"crypto_id":"￮","k":2}', '{"crypto_id":"\U0001f600","k":1}'],
        '{"prices": [[1, null], 3, [7]], "total_volumes": {"a": 1}}': [f'{{"market_cap":null,"price":null,"timestamp":{t},"volume":null}}' for t in (1, "null", 7)],
        '{"prices": [], "a": {"b": 1}}': ['{"a":{"b":1},"prices":[]}'],
        '{"results": [1], "Results": [2]}': ["1"],
        '{"Results": [2], "results": [1]}': ["2"],
        '{"results": {"a": 1}, "RESULTS": [3]}': ['{"RESULTS":[3],"results":{"a":1}}'],
        '[["a", "b"], [1], [1, 2, 3], null, 5]': ['{"a":1}', '{"a":1,"b":2}'],
        '[["a"], 5]': ['["a"]', "5"],
        '{"hourly": {"time": [null], "t": [2], "s": "x"}, "n": 1}': ['{"t":2,"time":null}'],
        "null": ["null"],
        "{}": ["{}"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, payload string")
    rows = documents.expand_records(df, "payload").select("id", "pos", F.to_json("record").alias("r")).orderBy("id", "pos").collect()
    assert {i: [r["r"] for r in rows if r["id"] == i] for i in range(len(cases))} == dict(enumerate(cases.values()))


def test_expansion_parses_a_payload_once(spark):
    df = spark.createDataFrame([('{"a": 1}',)], "payload string")
    plan = documents.expand_records(df, "payload")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(payload") == 1 and "from_json" not in plan.lower()  # a filter, the records and a map before
