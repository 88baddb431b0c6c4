"""Edits of whole documents against plain walks over parsed JSON."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import variants
from millrace.functions.text import NULL_WORDS
from millrace.operators import documents, profiler

KEYS = ["a", "B ", " c", "d.e", "[x", "Ä", "\u00a0q", "0", "a\\"]
TEXTS = ["", "  ", " N/A ", "null", "x  y\t z", "1,5", "12", "-3.5e2", "007", "1e999", "0.5", "\u00a0é\u2003w ", '{"[', "\\\"}]"]


def grow(rng, depth):
    kind = rng.random()
    if depth and kind < 0.3:
        return {rng.choice(KEYS): grow(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and kind < 0.5:
        return [grow(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 1, -20, 2.5, *TEXTS])


@pytest.fixture(scope="module")
def grown(spark):
    rng = random.Random(9)
    found = {i: {"k": grow(rng, 5), "l": grow(rng, 3)} if i % 9 else grow(rng, 4) for i in range(300)}
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in found.items()] + [(900, None), (901, "{broken"), (902, "")]
    return found, spark.createDataFrame(rows, "i int, doc string").repartition(3)


def read(frame, *more):
    rows = frame.select("i", F.to_json("doc").alias("doc"), "problem", *more).collect()
    return {r["i"]: json.loads(r["doc"]) for r in rows if r["doc"] is not None}, {r["i"]: r["problem"] for r in rows}, {r["i"]: r for r in rows}


def clean(v):
    if isinstance(v, dict):
        out = {}
        for k in sorted(v):
            if k.strip():
                out[k.strip().lower()] = clean(v[k])
        return out
    if isinstance(v, list):
        return [clean(x) for x in v]
    if isinstance(v, str):
        text = " ".join(v.split())
        return None if text.lower() in (*NULL_WORDS, "") else text
    return v


def without_nulls(v, at, dropped, compact):
    if isinstance(v, dict):
        dropped += [f"{at}.{k}" for k in v if v[k] is None]
        return {k: without_nulls(x, f"{at}.{k}", dropped, compact) for k, x in v.items() if x is not None}
    if isinstance(v, list):
        dropped += [f"{at}[{i}]" for i, x in enumerate(v) if x is None and compact]
        return [without_nulls(x, f"{at}[{i}]", dropped, compact) for i, x in enumerate(v) if x is not None or not compact]
    return v


def numbers(v):
    if isinstance(v, dict):
        return {k: numbers(x) for k, x in v.items()}
    if isinstance(v, list):
        return [numbers(x) for x in v]
    if isinstance(v, str) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v.strip()) and not re.match(r"0\d", v.strip()):
        return float(v) if abs(float(v)) < float("inf") else v
    return v


def leaves(v, at=""):
    if isinstance(v, dict):
        return [x for k in v for x in leaves(v[k], f"{at}.{k}")]
    if isinstance(v, list):
        return [x for i, y in enumerate(v) for x in leaves(y, f"{at}[{i}]")]
    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
    return [(at.removeprefix("."), kind, None if v is None else v if isinstance(v, str) else json.dumps(v))] if at else []


def no_python(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PROBLEMS = {900: None, 901: "parse_error", 902: "parse_error"}


def test_clean_equals_plain_walk(grown):
    found, rows = grown
    out = documents.clean_documents(rows, "doc")
    got, problems, _ = read(out)
    assert got == {i: clean(d) for i, d in found.items()}
    assert {i: p for i, p in problems.items() if i >= 900 or p} == PROBLEMS
    assert no_python(out)


@pytest.mark.parametrize("compact", [False, True])
def test_nulls_equal_plain_walk(grown, compact):
    found, rows = grown
    out = documents.drop_nulls(rows, "doc", compact)
    got, problems, raw = read(out, "dropped")
    for i, d in found.items():
        dropped: list = []
        assert got[i] == without_nulls(d, "", dropped, compact)
        assert sorted(raw[i]["dropped"]) == sorted(p.removeprefix(".") for p in dropped)
    assert {i: p for i, p in problems.items() if i >= 900 or p} == PROBLEMS
    assert no_python(out)


def test_numbers_equal_plain_walk(grown):
    found, rows = grown
    out = documents.coerce_numbers(rows, "doc")
    assert read(out)[0] == {i: numbers(d) for i, d in found.items()}
    assert no_python(out)


def test_leaves_equal_plain_walk(grown):
    found, rows = grown
    out = documents.flatten_paths(rows, ["i"], "doc")
    got = sorted(((r["i"], r["path"], r["type"], r["value"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *leaf) for i, d in found.items() for leaf in leaves(d)), key=repr)
    assert no_python(out)
    assert no_python(profiler.infer_fields(rows, "doc", ["i"]))


def test_levels_are_found_and_deeper_ones_reported(spark):
    rows = spark.createDataFrame([(1, '{"a": [{"b": "  [[{{ "}]}'), (2, "[" * 6 + "]" * 6), (3, '"[["'), (5, '{"[[[[": ["]{["]}'), (4, '{"a": "\\\\", "b": [" "]}')], "i int, doc string")
    assert {r["i"]: r["n"] for r in rows.select("i", variants.nesting(F.col("doc")).alias("n")).collect()} == {1: 3, 2: 6, 3: 2, 4: 2, 5: 2}
    got, problems, _ = read(documents.clean_documents(rows, "doc", levels=2))
    assert problems == {1: "too_deep", 2: "too_deep", 3: None, 4: None, 5: None}
    assert got[4] == {"a": "\\", "b": [None]}
    flat = documents.flatten_paths(rows.where("i = 1"), ["i"], "doc", levels=2).first()
    assert (flat["path"], flat["type"], json.loads(flat["value"])) == ("a[0]", "object", {"b": "  [[{{ "})


def test_deep_documents_are_edited_to_their_end(spark):
    deep = {"A": " x  y "}
    for _ in range(8):
        deep = {" K ": [deep, None]} if len(str(deep)) % 2 else {"Q": deep}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"b":" c  d"}')], "i int, doc string")
    levels = documents.levels_of(rows, "doc")
    assert 9 <= levels < documents.MOST_LEVELS
    assert read(documents.clean_documents(rows, "doc"))[0] == {1: clean(deep), 2: {"b": "c d"}}
    assert read(documents.drop_nulls(rows, "doc", True))[0][1] == without_nulls(deep, "", [], True)
    assert sorted(r["path"] for r in documents.flatten_paths(rows, ["i"], "doc").collect()) == sorted([*(p for p, _, _ in leaves(deep)), "b"])


def test_long_texts_do_not_break_the_level_count(spark):
    text = json.dumps({"a": "\\\"" * 200_000, "b": ["x" * 500_000]})
    rows = spark.createDataFrame([(1, text)], "i int, doc string")
    assert documents.levels_of(rows, "doc") == 2


EDITS = [
    ({"kind": "set", "to": "geo.region[1].name", "value": "eu"}, '{"x":1}', {"x": 1, "geo": {"region": [None, {"name": "eu"}]}}),
    ({"kind": "set", "to": "a.b", "value": [1, {"c": None}]}, '{"a":5}', {"a": {"b": [1, {"c": None}]}}),
    ({"kind": "set", "to": "a.b", "value": 1}, '{"a":[5]}', {"a": [5]}),
    ({"kind": "set", "to": "a[0]", "value": 1}, '{"a":{"x":2}}', {"a": {"x": 2, "0": 1}}),
    ({"kind": "set", "to": "a[2]", "value": None}, '{"a":[7]}', {"a": [7, None, None]}),
    ({"kind": " Delete ", "from": "a[1].b"}, '{"a":[1,{"b":2,"c":3}]}', {"a": [1, {"c": 3}]}),
    ({"kind": "delete", "from": "a[0]"}, '{"a":[1,2]}', {"a": [2]}),
    ({"kind": "delete", "from": "a"}, '{"a":null}', {}),
    ({"kind": "delete", "from": "a.b.c"}, '{"a":{"b":4}}', {"a": {"b": 4}}),
    ({"kind": "rename", "from": "a.b", "to": "c"}, '{"a":{"b":null}}', {"a": {}, "c": None}),
    ({"kind": "rename", "from": "x", "to": "y"}, '{"a":1}', {"a": 1}),
    ({"kind": "copy", "from": "a", "to": "a.b"}, '{"a":{"q":1}}', {"a": {"q": 1, "b": {"q": 1}}}),
    ({"kind": "copy", "from": "a.b[0]", "to": "x.y"}, '{"a":{"b":[1,{"c":null}]},"n":null}', {"a": {"b": [1, {"c": None}]}, "n": None, "x": {"y": 1}}),
]


def test_edits(spark):
    for edit, before, after in EDITS:
        rows = spark.createDataFrame([(1, before), (2, "{"), (3, None)], "i int, doc string")
        out = documents.edit_documents(rows, "doc", [edit])
        got, problems, _ = read(out)
        assert got == {1: after}, edit
        assert problems == {1: None, 2: "parse_error", 3: None}
        assert no_python(out)
    several = [{"kind": "copy", "from": "a.b[0]", "to": "x.y"}, {"kind": "rename", "from": "nope", "to": "z"}, {"kind": "delete", "from": "a.b[0]"}]
    rows = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":null}]}}')], "i int, doc string")
    assert read(documents.edit_documents(rows, "doc", several))[0] == {1: {"a": {"b": [{"c": None}]}, "x": {"y": 1}}}
    with pytest.raises(ValueError):
        documents.edit_documents(rows, "doc", [{"kind": "move"}])


def test_field_lists_are_not_sorted_row_by_row(spark):
    rows = spark.createDataFrame([(1, '{"a": null, "b": "x"}'), (2, '{"a": 4, "b": 5}'), (3, '{"a": "z"}')], "i int, doc string")
    fields = profiler.infer_fields(rows, "doc", ["i"])
    assert "SortAggregate" not in fields._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["type"], r["sample"], r["filled"]) for r in fields.collect()} == {("a", "number", "4", 2), ("b", "number", "x", 2)}


def test_heavy_scans_are_dealt_by_bytes_not_by_splits(spark, tmp_path, monkeypatch):
    spark.range(10_000).coalesce(1).write.parquet(f"{tmp_path}/rows")
    files = spark.read.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(session, "PIECE", 2_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:  # one row group is read by one task, however many splits are planned
        assert files.rdd.getNumPartitions() > 4
        assert sum(n > 0 for n in session.spread(files, "id").rdd.glom().map(len).collect()) > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
