"""Personal data by candidate gradient boosting, in column expressions and Spark's own boosted trees.

Base spans are the matches of strict patterns that pass their checks; they are always kept. Looser generators propose
more spans of the same kinds, which may overlap: numbers with unusual separators, national telephone numbers,
addresses in disguise. Boosted trees score these candidates by their format (digits, groups, checks
on the plain form) and context (cues in the words before, characters on both sides). A candidate is added if its
score reaches its kind's threshold, it overlaps no base span, and no better candidate that reached its own overlaps it.

There are no labelled spans, so they are made from all base spans, each with its
context: as they stand and in the generators' disguises as positives, damaged so that they fail
their check (and, for telephone numbers, with digits missing) as negatives, together with all matches that fail. Spans that look alike to the trees
are one training row with their number as its weight, so the fit does not grow with the texts. A fifth is held out, and sets for
every kind the lowest threshold at which ``PRECISION`` of the held-out spans at or above it are positive.

Texts are read once; what goes on is one row of spans and candidates per document. Spans are shuffled only to sort out
overlaps within their document: spans of one kind don't overlap each other, so of every kind only the last one that starts
before a span can reach into it, and all overlaps are found in one pass in text order.

Defined cases: a null or empty text has no spans; without base spans to learn from, nothing is added; repeated
rows are separate documents; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, whole
from .spans import digits, located, luhn

KINDS = ("email", "ip", "card", "phone")
# The strict patterns. Possessive quantifiers and look-behinds give the same matches without going back over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
# The looser generators; all repetitions are bounded.
AT = r"(?:\x20?[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20|\x20@\x20?|@\x20)"
DOT = r"(?:\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{AT}[A-Za-z0-9-]{{1,63}}(?:(?:{DOT}|\.)[A-Za-z0-9-]{{2,63}}){{1,4}}|@[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}}){{1,4}})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:(?:{DOT}|\x20?\.\x20?)[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2,3}(?:[\x20._/-]{1,2}[0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.,/_-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]{1,2}[0-9]{2,4}){2,4}(?![0-9A-Za-z._/-])",
}
# Words that speak for or against a kind when they stand right before a span.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|address|courriel|correo)[^0-9\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|host|server|addr|client|login|from)[^0-9\n]{0,24}$",
    "card": r"(?i)(?:card|visa|credit|debit|payment|pay|karte|carte|tarjeta)[^0-9\n]{0,24}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|ring|anruf)[^0-9\n]{0,24}$",
}
AGAINST = r"(?i)(?:version|\bv|isbn|issn|order|invoice|serial|part|page|rev|build|license|id|hash|date)[^0-9\n]{0,12}$"

PRECISION = 0.98
BEFORE, AFTER = 40, 8


def _passes(kind: str, value: Column) -> Column:
    number = digits(value)
    return {
        "email": F.lit(True),
        "ip": value.rlike(OCTETS),
        "card": F.length(number).between(13, 19) & luhn(number),
        "phone": F.length(number).between(9, 15),
    }[kind]


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda x: _passes(kind, x["value"])


def _failing(kind: str) -> Callable[[Column], Column]:
    return lambda x: ~_passes(kind, x["value"]) & F.length(x["value"]).between(9, 40)


def _around(found: Column, text: str) -> Column:
    """Spans with the text before and after them."""
    before = lambda x: F.substr(text, F.greatest(x["start"] - BEFORE, F.lit(0)) + 1, F.least(x["start"], F.lit(BEFORE)))
    return F.transform(found, lambda x: x.withField("before", before(x)).withField("after", F.substr(text, x["end"] + 1, F.lit(AFTER))))


def candidates(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): an id of the row, base spans, failed matches and candidates, each by kind."""
    out = docs.select("doc_id", whole().alias("text"))
    for kind in KINDS:
        out = located(out, "text", BASE[kind], f"m_{kind}")
        out = out.withColumn(f"m_{kind}", _around(F.filter(f"m_{kind}", lambda x: F.length(x["value"]) > 4), "text"))
        out = out.withColumn(f"base_{kind}", F.filter(f"m_{kind}", _passing(kind)))
        out = out.withColumn(f"fail_{kind}", F.filter(f"m_{kind}", _failing(kind)))
        out = located(out, "text", LOOSE[kind], f"loose_{kind}")
        out = out.withColumn(f"loose_{kind}", _around(F.col(f"loose_{kind}"), "text"))
    kept = [f"{part}_{kind}" for kind in KINDS for part in ("base", "fail", "loose")]
    return out.select(F.monotonically_increasing_id().alias("row"), "doc_id", *kept)


def features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add what the trees see of (kind, value, before, after)."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", AT, "@"), DOT, "."), r"\x20", "")
    out = df.withColumn("__plain", F.when(F.col("kind").isin("email", "ip"), plain).otherwise(F.col("value"))).withColumn("__number", digits(F.col("value")))
    n = F.length("__number")
    cue = F.coalesce(*[F.when(F.col("kind") == k, F.col("before").rlike(CUES[k])) for k in KINDS])
    last, next_ = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    columns = {f"f_{k}": F.col("kind") == k for k in KINDS} | {
        "f_digits": n,
        "f_length": F.length("value"),
        "f_other": F.length("value") - n,
        "f_groups": F.size(F.split("__number_groups", " ")),
        "f_different": F.size(F.array_distinct(F.split("__number", ""))),
        "f_luhn": (F.col("kind") == "card") & luhn(F.col("__number")),
        "f_octets": (F.col("kind") == "ip") & F.col("__plain").rlike(OCTETS),
        "f_address": (F.col("kind") == "email") & F.col("__plain").rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}$"),
        "f_shape": (F.col("kind") == "phone") & F.col("value").rlike(r"^(?:\+?[0-9]{1,3}[ .-]{1,2})?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"),
        "f_cue": cue,
        "f_against": F.col("before").rlike(AGAINST),
        "f_before_space": (last == "") | last.rlike(r"\s"),
        "f_after_end": (next_ == "") | next_.rlike(r"[\s.,;!?]"),
        "f_money": last.rlike(r"[$€£#=:]"),
    }
    out = out.withColumn("__number_groups", F.trim(F.regexp_replace("value", "[^0-9]+", " ")))
    return out.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in columns.items()]), list(columns)


def labelled(slim: DataFrame) -> DataFrame:
    """(kind, value, before, after, label) from all base spans and failed matches."""
    parts = []
    for kind in KINDS:
        for part, label in (("base", 1.0), ("fail", 0.0)):
            parts.append(slim.select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.explode(f"{part}_{kind}").alias("x")).select("kind", "x.value", "x.before", "x.after", "label"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    value, kind, good = F.col("value"), F.col("kind"), F.col("label") == 1.0
    disguised = (
        F.when(kind == "email", F.regexp_replace(F.regexp_replace(value, "@", " (at) "), r"\.", " (dot) "))
        .when(kind == "ip", F.regexp_replace(value, r"\.", "[.]"))
        .when(kind == "card", F.regexp_replace(digits(value), "([0-9]{4})(?=[0-9])", "$1."))
        .otherwise(F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]*", ""))
    )
    number = digits(value)
    damaged = (
        F.when(kind == "email", F.regexp_replace(value, "@.*$", " at the [dot] 1"))
        .when(kind == "ip", F.regexp_replace(value, r"^[0-9]+", "9999"))
        .when(kind == "card", F.regexp_replace(F.concat(F.substring(number, 1, 12), F.translate(F.substr(number, F.lit(13)), "0123456789", "1234567890")), "([0-9]{4})(?=[0-9])", "$1 "))
        .otherwise(F.regexp_replace(number, "^([0-9]{2})([0-9]{2}).*$", "$1-$2-19"))
    )
    return (
        rows.unionByName(rows.filter(good).withColumn("value", disguised))
        .unionByName(rows.filter(good).withColumn("value", damaged).withColumn("label", F.lit(0.0)))
        .filter(F.length("value") > 0)
    )


def training(slim: DataFrame) -> tuple[DataFrame, list[str]]:
    """The different rows that ``labelled`` shows to the trees, each with ``held`` and its number as ``weight``; and the features' names."""
    seen, names = features(labelled(slim))
    held = (F.pmod(F.xxhash64("before", "kind"), F.lit(5)) == 0).alias("held")
    return seen.groupBy("kind", "label", held, *names).agg(F.count("*").cast("double").alias("weight")), names


def scored(slim: DataFrame, precision: float = PRECISION) -> DataFrame | None:
    """The candidates with score and threshold of their kind; None where there is nothing to learn from."""
    train, names = training(slim)
    train = materialize(train.orderBy("kind", "label", "held", *names))
    seen = {r.label for r in train.select("label").distinct().collect()}
    if len(seen) < 2:
        return None
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    held = F.col("held")
    fitted = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=12, maxDepth=3, seed=1).fit(vectors.transform(train.filter(~held)))
    rate = lambda df: fitted.transform(vectors.transform(df)).withColumn("score", vector_to_array("probability")[1])
    bins = rate(train.filter(held)).groupBy("kind", F.round("score", 2).alias("bin")).agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("bin"))  # at most a hundred bins a kind
    reached = bins.withColumn("share", F.sum("good").over(above) / F.sum("n").over(above)).filter((F.col("share") >= precision) & (F.col("bin") >= 0.5))
    least = reached.groupBy("kind").agg(F.min("bin").alias("least"))
    loose = None
    for kind in KINDS:
        part = slim.select("row", F.lit(kind).alias("kind"), F.explode(f"loose_{kind}").alias("x")).select("row", "kind", "x.*")
        loose = part if loose is None else loose.unionByName(part)
    return rate(features(loose)[0]).join(F.broadcast(least), "kind").select("row", "kind", "start", "end", "score", "least")


def unbeaten(good: DataFrame, base: DataFrame) -> DataFrame:
    """(row, rank, start, end, score) of the candidates that overlap no span of ``base`` (row, rank, start, end) and no better candidate.

    A candidate is better by score, then by earlier start, then by the order of kinds.
    """
    fields = ("row", "rank", "start", "end")
    lanes = len(KINDS)  # base spans lie in the first lanes, candidates in the others
    every = base.select(*fields, F.col("rank").alias("lane"), F.lit(2.0).alias("score"))
    every = every.unionByName(good.select(*fields, (F.col("rank") + lanes).alias("lane"), F.col("score").cast("double")))
    span = F.struct("lane", "start", "end", "score")
    before = Window.partitionBy("row").orderBy("start", "lane").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("lane") == k, span), ignorenulls=True).over(before).alias(f"l{k}") for k in range(2 * lanes)]
    order = lambda x: F.struct(x["score"], -x["start"], -x["lane"])
    mine = F.struct(F.col("score"), -F.col("start"), -F.col("lane"))
    inside = lambda x: x.isNotNull() & (x["lane"] != F.col("lane")) & (x["end"] > F.col("start"))
    met = every.select("*", *last).withColumn("met", F.filter(F.array(*[f"l{k}" for k in range(2 * lanes)]), inside))
    met = materialize(met.select(*fields, "lane", "score", F.exists("met", lambda x: order(x) > mine).alias("lost"), F.filter("met", lambda x: order(x) < mine).alias("beats")))
    beaten = met.select("row", F.explode("beats").alias("x")).select("row", "x.lane", "x.start").distinct()
    return met.filter((F.col("lane") >= lanes) & ~F.col("lost")).join(beaten, ["row", "lane", "start"], "left_anti").select(*fields, "score")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id and ``base`` and ``spans``, arrays of (kind, start, end), kinds in the order of ``KINDS``."""
    slim = materialize(candidates(docs))
    brief = lambda kind: F.transform(f"base_{kind}", lambda x: F.struct(F.lit(KINDS.index(kind)).alias("rank"), x["start"].alias("start"), x["end"].alias("end")))
    slim_base = slim.select("row", "doc_id", F.concat(*[brief(k) for k in KINDS]).alias("base"))
    rated = scored(slim)
    if rated is None:
        out = slim_base.withColumn("spans", F.col("base"))
    else:
        rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
        good = rated.filter(F.round("score", 2) >= F.col("least")).withColumn("rank", rank)
        added = unbeaten(good, slim_base.select("row", F.explode("base").alias("x")).select("row", "x.*"))
        # documents and added spans meet in one aggregation: no side of it is held whole anywhere
        one = F.struct("rank", "start", "end").alias("x")
        mark = slim_base.withColumn("x", F.lit(None).cast("struct<rank:int,start:int,end:int>"))
        meets = mark.unionByName(added.select("row", one), allowMissingColumns=True)
        out = meets.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.first("base", ignorenulls=True).alias("base"), F.collect_list("x").alias("added")
        )
        out = out.withColumn("spans", F.concat("base", "added"))
    name = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select("doc_id", name(F.col("base")).alias("base"), name(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
