"""Secret scanning with a random forest against false positives, in column expressions and Spark's own trees.

Generators propose high-recall candidates: values of any length that are assigned to an identifier with a name like token or password in it,
long runs of mixed characters, and known key formats. A random forest then decides on each: by its length, shares of character
classes and changes between them, cover by dictionary words, the path it comes from, and the words on both sides. It is trained from
labelled findings (value, before, after, path, label). Where none are given, ``weak_findings`` labels a bounded
sample of the candidates by rules, and adds well-known kinds of false positives: the same values as digests or
commit ids, placeholders and readable names in place of values.

Texts are read once and nothing but candidates goes on. Values leave the operator as digests only.

Defined cases: a null or empty text has no findings, a null path is the empty path; where there is nothing to
learn from, every candidate is returned with a null score; repeated rows are separate; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, whole
from .spans import located

# Key formats, names that secrets are assigned to, words against a secret, and words of readable names.
KEYS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
NAMES = "token|secret|password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|key"
AGAINST = "sha1|sha256|sha512|md5|checksum|digest|commit|revision|uuid|guid|integrity|etag|hash|example|sample|dummy|placeholder|isbn|build"
DICTIONARY = (
    "access account action admin alpha and api app auth base beta body build cache change class client code common config content "
    "control core count current data date default demo dev docs document domain dummy email error event example field file first "
    "for format from front function global group hash head header home host html http https image index info input item json key "
    "label last layout level library link list local login main master menu message meta method model module name network new node "
    "null number object option order output package page parameter parent pass password path place plugin post private profile "
    "project prop public query read remote request resource response root route sample schema script search secret section select "
    "server service session setting simple site size source start state static status store string style system table tag target "
    "task template test text the this time title token tool tree type update url user username util value version view web widget "
    "with word work xxxx your"
).split()

# An identifier with such a name in it, up to the value. No part is tried twice, so the work is linear in runs of any length.
NAMED = rf"(?>[A-Za-z0-9_-]*?(?:{NAMES}))[A-Za-z0-9_-]*+[\"'\]]?[\x20\t]{{0,3}}(?::=|=>|[:=])[\x20\t]{{0,3}}[\"'`]?"
ASSIGNED = rf"(?i)(?<![A-Za-z0-9_-]){NAMED}[^\s\"'`<>]{{6,}}+"
VALUE = rf"(?i)^{NAMED}"
MIXED = rf"(?<![A-Za-z0-9+/_=-])(?:{KEYS}|(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{16,}}+)(?![A-Za-z0-9+/_=-])"
CLOSING = r"(?<![.,;:!?)\]}])[.,;:!?)\]}]++$"
# What may stand between such a name and the end of its identifier: further parts, but not the rest of a word like author.
REST = r"(?:(?:[_-]|(?=[A-Z0-9]))[A-Za-z0-9_-]{0,40})?"

SAMPLE = 4000
THRESHOLD = 0.5
BEFORE, AFTER = 40, 12


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, path) to one row per candidate: row, doc_id, path, start, end, value, before, after."""
    out = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("path", F.lit("")).alias("path"), whole().alias("text"))
    out = located(located(out, "text", ASSIGNED, "assigned"), "text", MIXED, "mixed")

    def value_only(x):
        value = F.regexp_replace(F.regexp_replace(x["value"], VALUE, ""), CLOSING, "")
        start = x["start"] + F.length(F.regexp_extract(x["value"], VALUE, 0))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    plain = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
    both = F.array_distinct(F.concat(F.transform("assigned", value_only), F.transform("mixed", plain)))
    before = lambda x: F.substr("text", F.greatest(x["start"] - BEFORE, F.lit(0)) + 1, F.least(x["start"], F.lit(BEFORE)))
    around = lambda x: x.withField("before", before(x)).withField("after", F.substr("text", x["end"] + 1, F.lit(AFTER)))
    long_ones = F.filter(both, lambda x: F.length(x["value"]) >= 6)
    return out.select("row", "doc_id", "path", F.explode(F.transform(long_ones, around)).alias("x")).select("row", "doc_id", "path", "x.*")


def features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add what the forest sees of (value, before, after, path)."""
    n = F.greatest(F.length("value"), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(F.regexp_replace(kinds, "[^aA0]", "-"), r"(.)\1++", "$1"))
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    columns = {
        "f_length": F.length("value"),
        "f_lower": share("[a-z]"),
        "f_upper": share("[A-Z]"),
        "f_digit": share("[0-9]"),
        "f_sign": share("[^A-Za-z0-9]"),
        "f_changes": (runs - 1) / n,
        "f_different": F.size(F.array_distinct(F.split("value", ""))) / n,
        "f_repeats": F.regexp_count("value", F.lit(r"(.)\1")) / n,
        "f_hex": F.col("value").rlike("^(?:[0-9a-f]++|[0-9A-F]++)$"),
        "f_words": 1 - F.length(F.regexp_replace(F.lower("value"), f"(?:{words})", "")) / n,
        "f_vowels": share("[aeiouAEIOU]"),
        "f_key_format": F.col("value").rlike(f"^(?:{KEYS})$"),
        "f_name_before": F.col("before").rlike(rf"(?i:{NAMES}){REST}[^A-Za-z0-9]{{0,8}}$"),
        "f_against_before": F.col("before").rlike(rf"(?i)(?:{AGAINST})[^A-Za-z0-9]{{0,8}}$"),
        "f_word_before": F.col("before").rlike(r"[A-Za-z]\s{1,4}$"),
        "f_assigned": F.col("before").rlike(r"[:=][\x20\t]{0,3}[\"'`]?$"),
        "f_quoted": F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]"),
        "f_in_path": F.col("before").rlike(r"[/\\.]$") | F.col("after").rlike(r"^(?:/|\.[a-z]{2,4}\b)"),
        "f_test_path": F.col("path").rlike("(?i)test|example|sample|doc|fixture|mock"),
        "f_path_depth": F.regexp_count("path", F.lit("[/\\\\]")),
    }
    return df.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in columns.items()]), list(columns)


def weak_findings(found: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled findings from at most about ``sample`` candidates."""
    total = found.count()
    place = F.pmod(F.xxhash64("row", "start"), F.lit(1 << 20)) / float(1 << 20)
    few = found.filter(place * total < sample).select("value", "before", "after", "path")
    random = (F.regexp_count("value", F.lit("[0-9]")) >= 3) & (F.size(F.array_distinct(F.split("value", ""))) >= 9) & (F.length("value") >= 16)
    named = F.col("before").rlike(rf"(?i:{NAMES}){REST}[\"'\]]?[\x20\t]{{0,3}}(?::=|=>|[:=])[\x20\t]{{0,3}}[\"'`]?$")
    against = F.col("before").rlike(rf"(?i)(?:{AGAINST})[^A-Za-z0-9]{{0,8}}$") | ~random
    label = F.when(F.col("value").rlike(f"^(?:{KEYS})$") | (random & named), 1.0).when(against, 0.0)
    marked = few.withColumn("label", label).filter("label is not null")
    good = marked.filter("label = 1")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("value", F.lit(by)), F.lit(len(words))) + 1).cast("int"))
    sign = pick(["-", "_", "", "."], 3)
    digests = good.withColumn("before", F.concat(pick(["sha256", "commit", "md5", "checksum", "revision", "uuid", "etag"], 1), pick([": ", " = \"", " ", "="], 2)))
    readable = good.withColumn("value", F.concat(pick(DICTIONARY, 4), sign, pick(DICTIONARY, 5), sign, pick(DICTIONARY, 6)))
    masked = good.withColumn("value", F.repeat(pick(["x", "*", "0", "A", "1234", "abc"], 9), 8))
    parts = [part.withColumn("label", F.lit(0.0)) for part in (digests, readable, masked)]
    return marked.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, path) to the findings that stay: doc_id, start, end, value_sha256, score."""
    found = materialize(candidates(docs))
    train, names = features(weak_findings(found, sample) if findings is None else findings)
    train = materialize(train.orderBy(F.xxhash64("value", "before", "after", "path"), "label"))
    rows = features(found)[0]
    if len(train.select("label").distinct().collect()) < 2:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        vectors = VectorAssembler(inputCols=names, outputCol="features")
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=24, maxDepth=6, seed=1).fit(vectors.transform(train))
        scored = forest.transform(vectors.transform(rows)).withColumn("score", vector_to_array("probability")[1]).filter(F.col("score") >= threshold)
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("value", 256).alias("value_sha256"), "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("path")))
