"""Jobs over a document column: paths, mapping, expansion, enrichment."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants
from ..functions.hashing import ABSENT, canonical_json, record_id
from ..functions.variants import let

#: Levels that an edit of whole documents is compiled for at most; what lies deeper is reported.
MOST_LEVELS = 16


def json_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in variants.parse_path(path))


def get_path(doc: Column, path: str, type_: str = "string") -> Column:
    """Value at ``a.b[0].c`` of a variant column; NULL where absent or of another type."""
    return F.try_variant_get(doc, json_path(path), type_)


def map_fields(doc: Column, mapping: Mapping[str, str], types: Mapping[str, str]) -> Column:
    """Nested struct built from a source-path to target-path mapping.

    ``types`` gives the Spark type per target path, string if absent.
    """
    tree: dict = {}
    for src, dst in mapping.items():
        at = tree
        *parents, leaf = dst.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[leaf] = get_path(doc, src, types.get(dst, "string"))

    def build(node) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return build(tree)


def coerce(df: DataFrame, doc: str, wanted: Mapping[str, str]) -> DataFrame:
    """Add one typed column per path; ``coerce_errors`` lists paths whose text does not convert.

    ``wanted`` maps a path to ``int``, ``float`` or ``bool``. Rows with errors belong in quarantine.
    """
    targets = {"int": "bigint", "float": "double", "bool": "boolean"}
    out, errors = df, []
    for path, kind in wanted.items():
        text = F.trim(get_path(F.col(doc), path))
        if kind == "bool":
            text = F.lower(text)
        name = path.replace(".", "_").replace("[", "_").replace("]", "")
        out = out.withColumn(name, text.try_cast(targets[kind]))
        errors.append(F.when(text.isNotNull() & F.col(name).isNull(), F.lit(f"{path}:{kind}")))
    return out.withColumn("coerce_errors", F.array_compact(F.array(*errors)))


def add_meta(df: DataFrame, meta: Mapping[str, str], ts: Column) -> DataFrame:
    return df.withColumn("_meta", F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], ts.alias("ts")))


def match_profile(df: DataFrame, rules: Sequence[tuple[str, Mapping[str, str]]]) -> DataFrame:
    """Add ``profile``: the first rule whose fields all match; ``*`` or blank matches anything."""
    choice = F.lit(None).cast("string")
    for name, fields in reversed(rules):
        test = F.lit(True)
        for column, want in fields.items():
            if want.strip() not in ("", "*"):
                test = test & (F.trim(F.coalesce(F.col(column), F.lit(""))) == want.strip())
        choice = F.when(test, F.lit(name)).otherwise(choice)
    return df.withColumn("profile", choice)


def levels_of(df: DataFrame, doc: str) -> int:
    """Levels of the deepest document, at most ``MOST_LEVELS``: one scan, a number per task."""
    return min(df.agg(F.max(variants.nesting(F.col(doc)))).first()[0] or 0, MOST_LEVELS)


def _rewritten(df: DataFrame, doc: str, levels: int | None, how: Callable[[Column, int], Column]) -> DataFrame:
    """``doc`` as a variant after ``how``, and ``problem``: ``parse_error``, or ``too_deep`` where levels were left as they are."""
    deep = levels_of(df, doc) if levels is None else levels
    v = F.try_parse_json(doc)
    problem = F.when(F.col(doc).isNull(), None).when(v.isNull(), "parse_error").when(variants.nesting(F.col(doc)) > deep, "too_deep")
    conf, name = df.sparkSession.conf, "spark.sql.analyzer.maxIterations"
    rounds = conf.get(name)
    try:  # the analyzer takes some rounds for every level of an expression
        conf.set(name, str(max(int(rounds), 25 * deep)))
        return df.withColumns({doc: let(v, lambda x: how(x, deep)), "problem": problem})
    finally:
        conf.set(name, rounds)


def clean_documents(df: DataFrame, doc: str, lower_keys: bool = True, drop_empty: bool = True, levels: int | None = None) -> DataFrame:
    """Trimmed (lower-case) keys, collapsed text, "no value" words as null. ``levels`` spares the scan that finds it."""
    return _rewritten(df, doc, levels, lambda v, n: variants.clean(v, n, lower_keys, drop_empty))


def drop_nulls(df: DataFrame, doc: str, compact_arrays: bool = False, levels: int | None = None) -> DataFrame:
    """Documents without null fields, and the paths of these as ``dropped``.

    Null array elements stay in place, and are not reported, unless ``compact_arrays``.
    """
    out = _rewritten(df, doc, levels, lambda v, n: variants.drop_nulls(v, n, compact_arrays))
    return out.withColumns({"dropped": F.coalesce(F.col(doc)["dropped"], F.array().cast("array<string>")), doc: F.col(doc)["doc"]})


def coerce_numbers(df: DataFrame, doc: str, levels: int | None = None) -> DataFrame:
    """Texts that look like numbers become numbers; a leading zero keeps them text."""
    return _rewritten(df, doc, levels, variants.coerce_numbers)


def edit_documents(df: DataFrame, doc: str, edits: Sequence[Mapping]) -> DataFrame:
    """Apply ``set`` (to, value), ``delete`` (from), ``rename`` and ``copy`` (from, to) in order; a missing source changes nothing."""
    v = F.try_parse_json(doc)
    problem = F.when(F.col(doc).isNotNull() & v.isNull(), "parse_error")
    return df.withColumns({doc: variants.edit(v, edits), "problem": problem})


def flatten_paths(df: DataFrame, keys: Sequence[str], doc: str, levels: int | None = None) -> DataFrame:
    """One row per leaf of every document: ``path``, ``type``, ``value``; null and unreadable documents have none.

    Level by level every object and array gives a row per child, and leaves pass on. What still is an object or array after
    the last level is given as its JSON text, of type ``object`` or ``array``.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.try_parse_json(doc).alias("__v"), F.lit("").alias("__path"))
    for _ in range(levels_of(df, doc) if levels is None else levels):
        children = spark.tvf.variant_explode_outer(F.col("__v").outer())
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        inner = F.col("pos").isNotNull()
        rows = rows.lateralJoin(children).select(
            *keys, F.when(inner, F.col("value")).otherwise(F.col("__v")).alias("__v"), F.when(inner, F.concat("__path", step)).otherwise(F.col("__path")).alias("__path")
        )
    kinds = {"OBJECT<>": None, "ARRAY<VOID>": None, "VOID": "null", "BOOLEAN": "boolean", "STRING": "string"}
    schema = F.schema_of_variant("__v")
    kind = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise("number")
    for name, value in kinds.items():
        kind = F.when(schema == name, value).otherwise(kind)
    # an empty array and one of nulls have the same schema; the first has no leaf
    kind = F.when((schema == "ARRAY<VOID>") & (F.size(variants.items(F.col("__v"))) > 0), "array").otherwise(kind)
    text = F.when(kind.isin("object", "array"), F.to_json("__v")).otherwise(variants.text_of(F.col("__v")))
    leaves = rows.where(F.col("__path") != "").select(*keys, variants.bare_path(F.col("__path")).alias("path"), kind.alias("type"), text.alias("value"))
    return leaves.where(F.col("type").isNotNull())


# --- expansion --------------------------------------------------------------------------------

#: Casts of a variant: rows of cells, lists by name, and names with whether the value is an object (NULL: it is none).
ROWS, LISTS, KINDS = "array<array<variant>>", "map<string,array<variant>>", "map<string,struct<>>"


def expand_records(df: DataFrame, payload: str, unreadable: str | None = None) -> DataFrame:
    """One row per record of each payload, as variant column ``record`` with its ``pos``.

    Recognised, in this order: ``prices`` with optional ``market_caps`` and ``total_volumes`` pair
    lists; an object whose values are all objects; ``hourly`` with parallel arrays; a header row
    followed by array rows; an array; ``{results: [...]}``; a single object.

    With ``unreadable`` a payload that is no JSON gives a row, too: without ``pos`` and ``record``, its text in that column.
    """
    rest = [c for c in df.columns if c != payload]
    records = let(F.try_parse_json(payload), lambda v: F.when(v.isNotNull(), _records(v, F.col(payload))))
    # the outer form keeps the planner from computing the records once more as a filter
    rows = df.select(*rest, F.col(payload).alias("__text"), F.posexplode_outer(records).alias("pos", "record"))
    found = F.col("pos").isNotNull()
    columns = [*rest, F.col("pos").cast("bigint").alias("pos"), "record"]
    if unreadable is None:
        return rows.where(found).select(*columns)
    # a payload without rows is an empty list or no JSON: only such texts are read once more
    return rows.where(found | F.try_parse_json("__text").isNull()).select(*columns, F.when(~found, F.col("__text")).alias(unreadable))


def _records(v: Column, text: Column) -> Column:
    """Records of one parsed payload. Shapes are told by single paths and by ``KINDS``, which copy no values; only the shape found is opened."""
    found = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    row = lambda path: F.try_variant_get(v, path, "array<struct<>>").isNotNull()
    lists = F.struct(*[F.try_variant_get(v, f"$.{n}", ROWS).alias(n) for n in ("prices", "market_caps", "total_volumes")])
    table = F.struct(F.try_variant_get(v, "$[0]", "array<string>").alias("header"), F.try_variant_get(v, "$", ROWS).alias("rows"))

    def of_object(kinds: Column) -> Column:
        objects = (F.size(kinds) > 0) & F.forall(F.map_values(kinds), lambda x: x.isNotNull())
        return (
            F.when(found("$.prices[0]"), let(lists, _quotes))
            .when(objects, let(variants.fields(v), _by_id))
            .when(found("$.hourly.time[0]"), let(F.try_variant_get(v, "$.hourly", LISTS), _by_hour))
            .otherwise(F.coalesce(let(_named_results(F.map_keys(kinds)), lambda names: _results(v, names, text)), F.array(v)))
        )

    of_array = F.when(row("$[0]") & row("$[1]"), let(table, _named)).otherwise(variants.items(v))
    return let(F.try_variant_get(v, "$", KINDS), lambda kinds: F.when(kinds.isNotNull(), of_object(kinds)).otherwise(F.coalesce(of_array, F.array(v))))


def _named_results(names: Column) -> Column:
    return F.filter(names, lambda k: F.lower(k) == "results")


def _results(v: Column, names: Column, text: Column) -> Column:
    """The list under the name found; of several spellings the first in the text counts."""
    first = F.when(F.size(names) == 1, F.get(names, 0)).otherwise(F.get(_named_results(F.json_object_keys(text)), 0))
    return F.when(F.size(names) > 0, variants.items(F.try_element_at(variants.fields(v), first)))


def _quotes(lists: Column) -> Column:
    """Time, price, cap and volume from parallel lists of pairs; the shortest filled list decides."""
    prices, caps, vols = lists["prices"], lists["market_caps"], lists["total_volumes"]
    filled = lambda c: F.nullif(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    length = F.least(F.size(prices), filled(caps), filled(vols))
    return F.transform(
        F.slice(prices, 1, length),
        lambda p, i: F.to_variant_object(
            F.struct(
                F.get(p, 0).alias("timestamp"),
                F.get(p, 1).alias("price"),
                F.get(F.get(caps, i), 1).alias("market_cap"),
                F.get(F.get(vols, i), 1).alias("volume"),
            )
        ),
    )


def _by_id(m: Column) -> Column:
    """One record per key, in key order, with the key as ``crypto_id``."""
    keys, entries = F.map_keys(m), F.map_entries(m)
    # a variant has its fields by UTF-16 units, which is the order of the bytes but for rare letters; variants can't be sorted along
    texts = F.sort_array(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))
    parsed = F.transform(texts, lambda e: F.struct(e["key"].alias("key"), F.parse_json(e["value"]).alias("value")))
    return F.transform(
        F.when(F.sort_array(keys) == keys, entries).otherwise(parsed),
        lambda e: F.to_variant_object(
            F.map_concat(
                F.create_map(F.lit("crypto_id"), e["key"].cast("variant")),
                F.map_filter(variants.fields(e["value"]), lambda n, _: n != "crypto_id"),
            )
        ),
    )


def _by_hour(lists: Column) -> Column:
    """One record per position of the ``time`` list, from all lists of that length."""
    steps = lambda ls: F.size(F.try_element_at(ls, F.lit("time")))
    same = F.map_filter(lists, lambda _, x: F.coalesce(F.size(x) == steps(lists), F.lit(False)))
    rows = lambda ls: F.transform(
        F.sequence(F.lit(0), steps(ls) - 1), lambda i: F.to_variant_object(F.transform_values(ls, lambda _, x: F.get(x, i)))
    )
    return let(same, rows)


def _named(table: Column) -> Column:
    """Array rows after a header row as objects."""
    header, rows = table["header"], table["rows"]
    body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: x.isNotNull())
    return F.transform(body, lambda cells: F.to_variant_object(_row_map(header, cells)))


def _row_map(header: Column, cells: Column) -> Column:
    n = F.least(F.size(header), F.size(cells))
    return F.map_from_arrays(F.slice(header, 1, n), F.slice(cells, 1, n))


def field_names(df: DataFrame, doc: str, limit: int) -> list[str] | None:
    """The names of all fields of the objects, sorted; None if there are more than ``limit``.

    Names are counted in Spark, one row per name and task before the shuffle; at most ``limit`` + 1 come to the driver.
    """
    names = df.select(F.explode(F.map_keys(F.from_json(doc, "map<string,string>"))).alias("name")).distinct().limit(limit + 1).collect()
    return None if len(names) > limit else sorted(r["name"] for r in names)


def column_names(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """A column for each name: as it is, or numbered where another column is called so, as Spark reads names without regard to case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        column, n = name, 2
        while column.lower() in used:
            column, n = f"{name}_{n}", n + 1
        used.add(column.lower())
        out.append(column)
    return out


def rows_to_table(df: DataFrame, doc: str, keys: Sequence[str], columns: Sequence[str] | None = None, widest: int = 2000) -> DataFrame:
    """Ragged objects as a table with a text column per field, NULL where a row lacks it.

    Without ``columns`` they are the sorted union of all fields, found by a first scan. A union wider than ``widest`` has no
    sensible schema: the fields come as the map ``fields`` then. With ``columns`` the fields that are not named come as the map
    ``others``, so that none is lost.
    """
    rows = df.withColumn("__fields", F.from_json(doc, "map<string,string>"))
    names = field_names(df, doc, widest) if columns is None else list(columns)
    if names is None:
        return rows.select(*keys, F.col("__fields").alias("fields"))
    extra = [] if columns is None else [F.map_filter("__fields", lambda k, _: ~k.isin(*names)).alias("others")]
    cells = [F.try_element_at("__fields", F.lit(n)).alias(c) for n, c in zip(names, column_names(names, [*keys, "others"]), strict=True)]
    return rows.select(*keys, *cells, *extra)


# --- enrichment -------------------------------------------------------------------------------


def enrich_static(df: DataFrame, pairs: Mapping[str, str], source: str = "static") -> DataFrame:
    """Constant pairs under ``_enrich``, each with its source."""
    entries = [x for k, v in pairs.items() for x in (F.lit(k), F.struct(F.lit(v).alias("value"), F.lit(source).alias("source")))]
    return _merge_enrich(df, F.create_map(*entries))


def enrich_derived(df: DataFrame, doc: str, meta: Mapping[str, Column], source: str = "derived") -> DataFrame:
    """Metadata pairs and the document hash under ``_enrich``."""
    values = {**meta, "doc_sha256": F.sha2(canonical_json(F.col(doc)), 256)}
    entries = [x for k, v in values.items() for x in (F.lit(k), F.struct(v.alias("value"), F.lit(source).alias("source")))]
    return _merge_enrich(df, F.create_map(*entries))


def _merge_enrich(df: DataFrame, new: Column) -> DataFrame:
    if "_enrich" in df.columns:
        kept = F.map_filter("_enrich", lambda k, _: ~F.map_contains_key(new, k))
        return df.withColumn("_enrich", F.map_concat(kept, new))
    return df.withColumn("_enrich", new)


def fill_time_dims(df: DataFrame, occurred: str) -> DataFrame:
    """``date``, ``year`` and ``month`` from the time where they are absent."""
    ts = F.try_to_timestamp(F.col(occurred).cast("string"))
    derived = {"date": F.to_date(ts), "year": F.year(ts), "month": F.month(ts)}
    return df.withColumns(
        {n: F.coalesce(F.col(n), c) if n in df.columns else c for n, c in derived.items()}
    )


def coerce_measures(measures: Column) -> Column:
    """Values of a measure map as numbers; texts that are none are left out."""
    numbers = F.transform_values(measures, lambda _, v: F.trim(v).try_cast("double"))
    return F.map_filter(numbers, lambda _, v: v.isNotNull())


def dims_from_id(profile: Column) -> Column:
    """Coin and time frame in an id like ``crypto-<coin>-<frame>``; NULL for the top lists."""
    fits = profile.rlike("^crypto-.+-[^-]*$") & ~profile.startswith("crypto-top10")
    part = lambda i: F.when(fits, F.nullif(F.regexp_extract(profile, "^crypto-(.+)-([^-]*)$", i), F.lit("")))
    return F.struct(part(1).alias("crypto_id"), part(2).alias("timeframe"))


def coerce_number_text(text: Column) -> Column:
    """Number in a text, unless a leading zero marks it as a code."""
    t = F.trim(text)
    n = t.try_cast("double")
    return F.when(~t.rlike("^0[0-9]") & ~F.isnan(n), n)


def with_record_id(df: DataFrame, doc: str) -> DataFrame:
    return df.withColumn("record_id", record_id(F.col(doc)))


def partition_key(tenant: Column, name: Column, ts: Column) -> Column:
    """``tenant/name/day``; a slash or percent sign within a part is written as in URLs, so that parts can't shift."""
    safe = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.concat_ws("/", *[F.coalesce(part, F.lit(ABSENT)) for part in (safe(tenant), safe(name), F.date_format(ts, "yyyy-MM-dd"))])
