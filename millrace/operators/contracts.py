"""Checks of documents and records, each returning an array of problem tokens (empty when valid)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variants import let
from .documents import get_path
from .positions import with_position, with_previous


def tokens(*found: Column) -> Column:
    """The tokens that are not NULL; none is blank. Unlike a filter with a lambda, this is compiled."""
    return F.array_remove(F.array(*[F.coalesce(t, F.lit("")) for t in found]), "") if found else F.array().cast("array<string>")


def kind_of(v: Column) -> Column:
    """JSON type name of a variant; NULL where there is no value at all."""
    return let(
        F.schema_of_variant(v),
        lambda t: F.when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "bool")
        .when(t == "VOID", "null")
        .when(t.isNotNull(), "number"),
    )


def validate_rules(doc: Column, rules: Sequence[tuple[str, str, bool]]) -> Column:
    """Sorted violations of (path, type, required) rules over a variant document; each path is read once."""

    def problem(path: str, want: str, required: bool) -> Column:
        wrong = lambda got: F.lit(False) if want in ("", "any") else (got != want)
        return let(
            kind_of(get_path(doc, path, "variant")),
            lambda got: F.when(got.isNull(), F.lit(f"missing:{path}") if required else F.lit(None)).when(
                wrong(got), F.concat(F.lit(f"type_mismatch:{path}:{want}:"), got)
            ),
        )

    return F.sort_array(tokens(*[problem(*rule) for rule in rules]))


# --- JSON Schema contracts --------------------------------------------------------------------


# fixed values: the keywords that are checked, and those that check nothing
KEYWORDS = (
    "type const enum minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf items minItems maxItems "
    "required properties additionalProperties minProperties maxProperties propertyNames allOf anyOf oneOf not"
).split()
NUMERIC = {"number", "integer", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
ANNOTATIONS = "$schema $id $comment title description default examples format deprecated readOnly writeOnly".split()


def validate_contract(schema: Mapping, doc: Column, at: str = "$") -> Column:
    """Problems of a variant document against a JSON Schema, compiled once into one expression.

    Covers the keywords in ``KEYWORDS``. Any other keyword that is no annotation raises: a rule that
    is not checked must not look like one that holds. Every node of the document is read once.
    """
    return let(doc, lambda d: _validate_node(schema, d, at))


def _bad_name(schema: Mapping, name: Column) -> Column:
    """Does a property's name break the schema for names? The usual rules for texts need no document of the name."""
    tests = {
        "pattern": lambda x: ~name.rlike(x),
        "minLength": lambda x: F.length(name) < x,
        "maxLength": lambda x: F.length(name) > x,
        "enum": lambda x: ~name.isin(*[n for n in x if isinstance(n, str)]),
    }
    if set(schema) <= set(tests):
        bad = F.lit(False)
        for word, value in schema.items():
            bad = bad | tests[word](value)
        return bad
    return F.size(validate_contract({"items": schema}, F.parse_json(F.to_json(F.array(name))))) > 0


def _validate_node(schema: Mapping, doc: Column, at: str) -> Column:
    """Problems of a bound document: its type and its number are found once, then all checks use them."""
    unknown = set(schema) - set(KEYWORDS) - set(ANNOTATIONS)
    if unknown:
        raise ValueError(f"{at}: schema keywords without a check: {sorted(unknown)}")
    number = lambda t: F.when(
        t.startswith("BIGINT") | t.startswith("DOUBLE") | t.startswith("FLOAT") | t.startswith("DECIMAL"), F.try_variant_get(doc, "$", "double")
    )
    if not NUMERIC & {*schema, *([schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", []))}:
        return let(F.schema_of_variant(doc), lambda t: _problems(schema, doc, t, F.lit(None).cast("double"), at))
    return let(F.schema_of_variant(doc), lambda t: let(number(t), lambda n: _problems(schema, doc, t, n, at)))


def _problems(schema: Mapping, doc: Column, t: Column, number: Column, at: str) -> Column:
    is_object, is_array, is_text = t.startswith("OBJECT"), t.startswith("ARRAY"), t == "STRING"
    text = F.when(is_text, F.try_variant_get(doc, "$", "string"))
    size = F.when(is_array, F.size(F.try_variant_get(doc, "$", "array<variant>")))
    flag = lambda bad, word: F.when(bad, F.lit(f"{at}:{word}"))
    found, nested = [], []

    if "type" in schema:
        allowed = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        tests = {
            "object": is_object,
            "array": is_array,
            "string": is_text,
            "boolean": t == "BOOLEAN",
            "null": t == "VOID",
            "number": number.isNotNull(),
            "integer": number.isNotNull() & (number == F.floor(number)),
        }
        fits = F.lit(False)
        for name in allowed:
            fits = fits | F.coalesce(tests[name], F.lit(False))
        found.append(flag(~fits, "type"))
    plain = F.to_json(doc)
    literal = lambda x: F.to_json(F.parse_json(F.lit(json.dumps(x))))
    if "const" in schema:
        found.append(flag(~plain.eqNullSafe(literal(schema["const"])), "const"))
    if "enum" in schema:
        found.append(flag(~F.coalesce(plain.isin(*[literal(x) for x in schema["enum"]]), F.lit(False)), "enum"))
    bounds = {
        "minLength": lambda x: F.length(text) < x,
        "maxLength": lambda x: F.length(text) > x,
        "pattern": lambda x: ~text.rlike(x),
        "minimum": lambda x: number < x,
        "maximum": lambda x: number > x,
        "exclusiveMinimum": lambda x: number <= x,
        "exclusiveMaximum": lambda x: number >= x,
        "multipleOf": lambda x: (number / x) != F.floor(number / x),
        "minItems": lambda x: size < x,
        "maxItems": lambda x: size > x,
    }
    found += [flag(test(schema[word]), word) for word, test in bounds.items() if word in schema]
    present = lambda name: F.try_variant_get(doc, f"$['{name}']", "variant")
    for name in schema.get("required", []):
        found.append(F.when(is_object & present(name).isNull(), F.lit(f"{at}.{name}:required")))
    keys = F.when(is_object, F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>")))
    for word, bad in (("minProperties", lambda n: F.size(keys) < n), ("maxProperties", lambda n: F.size(keys) > n)):
        if word in schema:
            found.append(flag(is_object & bad(schema[word]), word))
    if "propertyNames" in schema:
        wrong = F.filter(keys, lambda k: _bad_name(schema["propertyNames"], k))
        found.append(flag(is_object & (F.size(wrong) > 0), "propertyNames"))
    known = schema.get("properties", {})
    for name, sub in known.items():
        inner = lambda c: F.when(c.isNotNull(), _validate_node(sub, c, f"{at}.{name}"))  # noqa: B023
        nested.append(let(F.when(is_object, present(name)), inner))
    extra = schema.get("additionalProperties", True)
    if extra is not True:
        fields = F.when(is_object, F.try_variant_get(doc, "$", "map<string,variant>"))
        others = F.map_filter(fields, lambda k, _: ~k.isin(*known) if known else F.lit(True))
        if extra is False:
            nested.append(F.transform(F.map_keys(others), lambda k: F.concat(F.lit(f"{at}."), k, F.lit(":additional"))))
        else:
            nested.append(F.flatten(F.transform(F.map_values(others), lambda x: _validate_node(extra, x, f"{at}.*"))))
    if "items" in schema:
        items = F.when(is_array, F.try_variant_get(doc, "$", "array<variant>"))
        nested.append(F.flatten(F.transform(items, lambda x: _validate_node(schema["items"], x, f"{at}[]"))))
    passing = lambda sub: F.size(_validate_node(sub, doc, at)) == 0
    nested += [_validate_node(sub, doc, at) for sub in schema.get("allOf", [])]
    for word, bad in (("anyOf", lambda n: n < 1), ("oneOf", lambda n: n != 1)):
        if word in schema:
            hits = sum((passing(sub).cast("int") for sub in schema[word]), F.lit(0))
            found.append(flag(bad(hits), word))
    if "not" in schema:
        found.append(flag(passing(schema["not"]), "not"))
    empty = F.array().cast("array<string>")
    # flattened, as concat of several lists costs more per row
    return F.flatten(F.array(tokens(*found), *[F.coalesce(n, empty) for n in nested])) if nested else tokens(*found)


# --- typed envelopes --------------------------------------------------------------------------

# fixed values: accepted shapes of identifiers and the states of a case
OPAQUE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
EVENT_TYPE = r"^[a-z][a-z0-9._-]{0,95}$"
SHA256 = r"^[0-9a-f]{64}$"
ANY_CASE_SHA256 = r"^[0-9a-fA-F]{64}$"
SOURCE_KIND = r"^[a-z][a-z0-9._-]{0,63}$"
SOURCE_STATES = ("active", "paused", "error", "disabled")
SOURCE_HEALTH = ("healthy", "degraded", "unhealthy")
SOURCE_TEXTS = {"name": 128, "owner_id": 128, "team": 128, "oncall_rotation": 128, "schema_ref": 256, "notes": 2048}
SOURCE_LIMITS = {"rate_limit_rps": 100_000, "max_concurrency": 100_000, "daily_quota": 1_000_000_000}
MAX_SOURCE_LABELS, MAX_EXTERNAL_REF, MAX_FAILURES = 32, 1024, 1_000_000
CASE_STATES = ("open", "investigate", "mitigated", "resolved", "closed", "rejected")
CASE_SEVERITIES = ("low", "medium", "high", "critical")
CASE_PRIORITIES = ("p3", "p2", "p1", "p0")
CASE_MOVES = {
    "open": ("investigate", "rejected", "closed"),
    "investigate": ("mitigated", "resolved", "rejected", "closed"),
    "mitigated": ("investigate", "resolved", "closed"),
    "resolved": ("closed",),
    "rejected": ("closed",),
    "closed": (),
}


def _text_rule(name: str, pattern: str, required: bool = True) -> Column:
    text = F.trim(F.col(name))
    blank = F.coalesce(text == "", F.lit(True))
    missing = F.lit(f"{name}:required") if required else F.lit(None)
    return F.when(blank, missing).when(~text.rlike(pattern), F.lit(f"{name}:invalid"))


def _choice_rule(name: str, allowed: Sequence[str]) -> Column:
    ok = F.coalesce(F.lower(F.trim(name)).isin(*allowed), F.lit(False))
    return F.when(~ok, F.lit(f"{name}:invalid"))


def _needed(*names: str) -> list[Column]:
    return [F.when(F.col(n).isNull(), F.lit(f"{n}:required")) for n in names]


def validate_event() -> Column:
    """Problems of event envelope rows: identifiers, type, times, the ids it refers to, and its hashes in either case."""
    links = ("trace_id", "span_id", "parent_event_id", "correlation_id")
    return tokens(
        _text_rule("id", OPAQUE_ID),
        _text_rule("tenant", OPAQUE_ID),
        _text_rule("type", EVENT_TYPE),
        *_needed("occurred", "emitted"),
        *[_text_rule(name, OPAQUE_ID, required=False) for name in links],
        _text_rule("prev_hash", ANY_CASE_SHA256, required=False),
        _text_rule("hash", ANY_CASE_SHA256, required=False),
    )


def validate_source() -> Column:
    """Problems of source rows: identity, state, bounded texts and limits, schema and configuration hashes."""
    ref = F.trim("external_ref")
    return tokens(
        _text_rule("id", OPAQUE_ID),
        _text_rule("tenant", OPAQUE_ID),
        _text_rule("kind", SOURCE_KIND),
        F.when(F.coalesce(ref == "", F.lit(True)), F.lit("external_ref:required")).when(
            (F.octet_length(ref) > MAX_EXTERNAL_REF) | ref.rlike(r"[\n\r\t]"), F.lit("external_ref:invalid")
        ),
        _choice_rule("status", SOURCE_STATES),
        _choice_rule("health", SOURCE_HEALTH),
        *_needed("created", "updated"),
        F.when(F.col("updated") < F.col("created"), F.lit("updated:before_created")),
        *[F.when(F.octet_length(name) > most, F.lit(f"{name}:too_long")) for name, most in SOURCE_TEXTS.items()],
        *[F.when(~F.col(name).between(0, most), F.lit(f"{name}:invalid")) for name, most in SOURCE_LIMITS.items()],
        F.when(F.col("consecutive_failures") > MAX_FAILURES, F.lit("consecutive_failures:invalid")),
        F.when(F.col("config_version") < 0, F.lit("config_version:invalid")),
        F.when(F.size("labels") > MAX_SOURCE_LABELS, F.lit("labels:too_many")),
        *[_text_rule(name, SHA256, required=False) for name in ("schema_hash", "config_hash", "prev_hash", "hash")],
    )


def validate_case() -> Column:
    """Problems of case rows; list members are checked as well as the scalar fields."""
    members = F.coalesce(F.exists("related_events", lambda x: ~x.rlike(OPAQUE_ID)), F.lit(False))
    return tokens(
        _text_rule("id", OPAQUE_ID),
        _text_rule("tenant", OPAQUE_ID),
        F.when(F.coalesce(F.trim("title") == "", F.lit(True)), F.lit("title:required")),
        _choice_rule("status", CASE_STATES),
        _choice_rule("severity", CASE_SEVERITIES),
        _choice_rule("priority", CASE_PRIORITIES),
        *_needed("created", "updated"),
        F.when(F.col("updated") < F.col("created"), F.lit("updated:before_created")),
        F.when(members, F.lit("related_events:invalid")),
    )


def validate_artifact() -> Column:
    """Problems of stored-object rows (key, hash, size, capture time)."""
    return tokens(
        _text_rule("id", OPAQUE_ID),
        _text_rule("tenant", OPAQUE_ID),
        _text_rule("sha256", SHA256),
        F.when(F.coalesce(F.col("size_bytes") < 0, F.lit(True)), F.lit("size_bytes:invalid")),
        *_needed("captured_at"),
    )


def validate_metric() -> Column:
    """Problems of metric rows: exactly the value form its type asks for, ordered buckets and quantiles."""
    scalar, hist, summ = F.col("scalar"), F.col("histogram"), F.col("summary")
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    kind = F.lower(F.trim("type"))
    steps = lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.struct(F.get(c, i - 1).alias("a"), F.get(c, i).alias("b"))
    )
    climbs = lambda c, bad: has(c) & (F.size(c) > 1) & F.exists(steps(c), bad)
    return tokens(
        F.when(~F.coalesce(kind.isin("gauge", "counter", "histogram", "summary"), F.lit(False)), F.lit("type:invalid")),
        _text_rule("tenant", OPAQUE_ID),
        *_needed("observed"),
        F.when(kind.isin("gauge", "counter") & (scalar.isNull() | has(hist) | has(summ)), F.lit("value:scalar_only")),
        F.when((kind == "counter") & (scalar < 0), F.lit("value:negative_counter")),
        F.when((kind == "histogram") & (scalar.isNotNull() | has(summ) | ~has(hist)), F.lit("value:histogram_only")),
        F.when((kind == "summary") & (scalar.isNotNull() | has(hist) | ~has(summ)), F.lit("value:summary_only")),
        F.when(climbs(hist, lambda s: s["b"]["le"] <= s["a"]["le"]), F.lit("histogram:le_order")),
        F.when(climbs(hist, lambda s: s["b"]["count"] < s["a"]["count"]), F.lit("histogram:count_order")),
        F.when(has(summ) & F.exists(summ, lambda q: (q["q"] < 0) | (q["q"] > 1)), F.lit("summary:range")),
        F.when(climbs(summ, lambda s: s["b"]["q"] <= s["a"]["q"]), F.lit("summary:q_order")),
    )


def case_transitions(history: DataFrame, keys: Sequence[str], order: Sequence[str], status: str = "status") -> DataFrame:
    """Status changes the transition table does not allow.

    Repeated states are no change. The previous state is looked up block by block, so a case with
    very many rows is spread over tasks.
    """
    placed = with_previous(with_position(history, keys, order), keys, [status]).drop("idx")
    moved = placed.withColumnRenamed(f"prev_{status}", "from_status").where(F.col("from_status") != F.col(status))
    allowed = F.lit(False)
    for state, following in CASE_MOVES.items():
        if following:
            allowed = allowed | ((F.col("from_status") == state) & F.col(status).isin(*following))
    return moved.where(~allowed)


def verify_payload_hash(df: DataFrame, content: str, stored: str) -> DataFrame:
    """Rows whose stored SHA-256 is not the hash of the content."""
    return df.withColumn("computed", F.sha2(F.col(content).cast("binary"), 256)).where(
        ~F.col("computed").eqNullSafe(F.lower(F.trim(stored)))
    )
