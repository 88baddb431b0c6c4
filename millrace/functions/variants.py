"""Edits of JSON documents as expressions over variant columns: no Python, no shuffle.

An edit that visits every node is compiled for a number of levels (``nesting`` tells how many a document needs): a level opens
objects and arrays alike into entries, does the entries' values by the next level's expression and puts the node together
again, so the expression grows with the levels and not with the documents. Edits at known paths need no number of levels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NULL_WORDS

FIELDS, ITEMS = "map<string,variant>", "array<variant>"
FEW = 3
#: White space, a character at a time.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that its uses in ``body`` don't compute it again.

    As the last step of a fold over nothing, which starts from ``value``: no array is built, and no type of an element is looked up per row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def nesting(text: Column) -> Column:
    """Levels of objects and arrays in a JSON text; a plain value has none.

    Texts with at most ``FEW`` opening brackets, in strings or not, are not looked into: they count as so many levels.
    """
    opened = F.length(text) - F.length(F.translate(text, "[{", ""))
    return F.when(opened <= FEW, opened).otherwise(_nesting(text))


def _nesting(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*+"|[^\[\]{}"]++', "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))
    deeper = lambda s, x: F.struct((s["at"] + x).alias("at"), F.greatest(s["top"], s["at"] + x).alias("top"))
    return F.aggregate(steps, zero, deeper, lambda s: s["top"])


def null() -> Column:
    return F.parse_json(F.lit("null"))


def fields(v: Column) -> Column:
    """The fields of an object as a map; NULL for other values."""
    return F.try_variant_get(v, "$", FIELDS)


def items(v: Column) -> Column:
    """The elements of an array; NULL for other values."""
    return F.try_variant_get(v, "$", ITEMS)


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _entries(m: Column, a: Column) -> Column:
    of_array = F.transform(a, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.when(m.isNotNull(), F.map_entries(m)).when(a.isNotNull(), of_array)


def _last_of_each(entries: Column) -> Column:
    """Of entries with the same key the last, and none without a name; the test for such keys comes first, as they are rare."""
    keys = F.array_distinct(F.transform(entries, lambda e: F.nullif(e["key"], F.lit(""))))
    n = F.size(entries)
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda x: x["key"] == e["key"])
    last = F.filter(entries, lambda e, i: (e["key"] != "") & ~later(e, i))
    return F.when((F.size(keys) < n) | F.array_contains(F.transform(keys, lambda k: k.isNull()), True), last).otherwise(entries)


def rewrite(v: Column, levels: int, leaf: Callable[[Column], Column], key: Callable[[Column], Column] | None = None) -> Column:
    """The document with ``leaf`` applied to its plain values and ``key`` to its field names; blank names go, repeated ones keep the last."""
    if levels == 0:
        return leaf(v)

    def node(opened: Column) -> Column:
        m, a = opened["m"], opened["a"]
        name = (lambda e: e["key"]) if key is None else (lambda e: key(e["key"]))
        done = F.transform(_entries(m, a), lambda e: F.struct(name(e).alias("key"), rewrite(e["value"], levels - 1, leaf, key).alias("value")))

        def built(d: Column) -> Column:
            named = d if key is None else _last_of_each(d)
            return F.when(m.isNotNull(), F.to_variant_object(F.map_from_entries(named))).otherwise(F.to_variant_object(F.transform(d, lambda e: e["value"])))

        return F.when(m.isNotNull() | a.isNotNull(), let(done, built)).otherwise(leaf(v))

    return let(F.struct(fields(v).alias("m"), items(v).alias("a")), node)


def clean(v: Column, levels: int, lower_keys: bool = True, drop_empty: bool = True) -> Column:
    """Trimmed (lower-case) keys, collapsed text, "no value" words (and, with ``drop_empty``, blank texts) as null."""
    words = [*NULL_WORDS, *([""] if drop_empty else [])]

    def leaf(x: Column) -> Column:
        done = let(F.regexp_replace(F.btrim(text_of(x), F.lit(BLANKS)), f"[{BLANKS}]+", " "), lambda t: F.when(F.lower(t).isin(*words), null()).otherwise(t.cast("variant")))
        return F.when(is_text(x), done).otherwise(x)

    def name(k: Column) -> Column:
        trimmed = F.btrim(k, F.lit(BLANKS))
        return F.lower(trimmed) if lower_keys else trimmed

    return rewrite(v, levels, leaf, name)


def coerce_numbers(v: Column, levels: int) -> Column:
    """Texts that look like finite numbers become numbers; a leading zero keeps them text."""

    def leaf(x: Column) -> Column:
        def number(t: Column) -> Column:
            n = t.try_cast("double")
            return F.when(t.rlike(NUMBER) & ~t.rlike(r"\A0[0-9]") & (F.abs(n) < float("inf")), n.cast("variant")).otherwise(x)

        return F.when(is_text(x), let(F.trim(text_of(x)), number)).otherwise(x)

    return rewrite(v, levels, leaf)


def drop_nulls(v: Column, levels: int, compact: bool = False) -> Column:
    """Struct of the document without null fields (``doc``) and their paths (``dropped``); null elements only if ``compact``."""
    none = F.array().cast("array<string>")

    def walk(x: Column, left: int) -> Column:
        plain = F.struct(x.alias("doc"), none.alias("dropped"))
        if left == 0:
            return plain

        def node(opened: Column) -> Column:
            m, a = opened["m"], opened["a"]

            def entry(e: Column, i: Column) -> Column:
                step = F.when(m.isNotNull(), F.concat(F.lit("."), e["key"])).otherwise(F.concat(F.lit("["), i.cast("string"), F.lit("]")))
                goes = F.is_variant_null(e["value"]) & (m.isNotNull() | F.lit(compact))
                return F.struct(e["key"].alias("key"), step.alias("step"), goes.alias("goes"), walk(e["value"], left - 1).alias("r"))

            def built(d: Column) -> Column:
                kept = F.filter(d, lambda e: ~e["goes"])
                of_map = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["r"]["doc"])))
                made = F.when(m.isNotNull(), F.to_variant_object(of_map)).otherwise(F.to_variant_object(F.transform(kept, lambda e: e["r"]["doc"])))
                below = lambda e: F.transform(e["r"]["dropped"], lambda p: F.concat(e["step"], p))
                dropped = F.flatten(F.transform(d, lambda e: F.when(e["goes"], F.array(e["step"])).otherwise(below(e))))
                return F.struct(made.alias("doc"), dropped.alias("dropped"))

            return F.when(m.isNotNull() | a.isNotNull(), let(F.transform(_entries(m, a), entry), built)).otherwise(plain)

        return let(F.struct(fields(x).alias("m"), items(x).alias("a")), node)

    return let(walk(v, levels), lambda r: F.struct(r["doc"].alias("doc"), F.transform(r["dropped"], bare_path).alias("dropped")))


def bare_path(path: Column) -> Column:
    """A path without the dot before its first name."""
    return F.when(path.startswith("."), F.substr(path, F.lit(2))).otherwise(path)


# --- edits at known paths ------------------------------------------------------------------------


def parse_path(path: str) -> list[str | int]:
    """``a.b[0].c`` as a list of names and positions."""
    return [int(x) if x.isdigit() else x for x in re.sub(r"\[(\d+)\]", r".\1", path.strip()).split(".") if x]


def child(v: Column, step: str | int) -> Column:
    """The value at a name or position; NULL where there is none. A number names a field of an object, too."""
    of_object = F.try_element_at(fields(v), F.lit(str(step)))
    return F.coalesce(F.get(items(v), F.lit(step)), of_object) if isinstance(step, int) else of_object


def find(v: Column, steps: Sequence[str | int]) -> Column:
    for step in steps:
        v = child(v, step)
    return v


def put(v: Column, steps: Sequence[str | int], value: Column) -> Column:
    """The document with ``value`` at a path; missing objects and array slots are made, a name in an array or a plain value changes nothing."""
    if not steps:
        return v
    step, rest = steps[0], steps[1:]

    def inner(old: Column) -> Column:
        if not rest:
            return value
        fresh = F.parse_json(F.lit("[]" if isinstance(rest[0], int) else "{}"))
        return let(F.when(fields(old).isNotNull() | items(old).isNotNull(), old).otherwise(fresh), lambda x: put(x, rest, value))

    def in_object(m: Column) -> Column:
        others = F.map_filter(m, lambda k, _: k != str(step))
        return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(str(step)), inner(F.try_element_at(m, F.lit(str(step)))))))

    def in_array(a: Column) -> Column:
        longer = F.concat(a, F.array_repeat(null(), F.greatest(F.lit(step + 1) - F.size(a), F.lit(0))))
        return F.to_variant_object(F.transform(longer, lambda x, i: F.when(i == step, inner(x)).otherwise(x)))

    out = F.when(fields(v).isNotNull(), let(fields(v), in_object))
    if isinstance(step, int):
        out = out.when(items(v).isNotNull(), let(items(v), in_array))
    return out.otherwise(v)


def remove(v: Column, steps: Sequence[str | int]) -> Column:
    """The document without the value at a path; a missing one changes nothing."""
    if not steps:
        return v
    step, rest = steps[0], steps[1:]
    if rest:
        return F.when(find(v, steps).isNotNull(), put(v, [step], remove(child(v, step), rest))).otherwise(v)
    out = F.when(fields(v).isNotNull(), F.to_variant_object(F.map_filter(fields(v), lambda k, _: k != str(step))))
    if isinstance(step, int):
        out = out.when(items(v).isNotNull(), F.to_variant_object(F.filter(items(v), lambda _, i: i != step)))
    return out.otherwise(v)


def _moved(v: Column, source: list, target: list, keep: bool) -> Column:
    def move(pair: Column) -> Column:
        x, found = pair["v"], pair["found"]
        return F.when(found.isNull(), x).otherwise(put(x if keep else remove(x, source), target, found))

    return let(F.struct(v.alias("v"), find(v, source).alias("found")), move)


def _edited(v: Column, kind: str, source: list, target: list, value: Column) -> Column:
    if kind == "set":
        return let(v, lambda x: put(x, target, value))
    if kind == "delete":
        return let(v, lambda x: remove(x, source))
    if kind in ("rename", "copy"):
        return let(v, lambda x: _moved(x, source, target, kind == "copy"))
    raise ValueError("unknown edit kind")


def edit(v: Column, edits: Sequence[dict]) -> Column:
    """Apply ``set`` (to, value), ``delete`` (from), ``rename`` and ``copy`` (from, to) in order; a missing source changes nothing."""
    for e in edits:
        value = F.parse_json(F.lit(json.dumps(e.get("value"))))
        v = _edited(v, e["kind"].strip().lower(), parse_path(e.get("from", "")), parse_path(e.get("to", "")), value)
    return v
