"""A training-data pipeline: language, near duplicates, benchmark leaks, mixing and token ids, over ``documents``.

Every stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept; between stages the rows are
written and read again. All stages but the last return the columns of ``docs``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, langid, mixing, tokens
from millrace.session import materialize

#: A document goes if less of its text than this belongs to its language; clean documents of known languages are far above.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show; texts that are null or have no letter go too."""
    names = ("__language", "__share")
    rated = langid.identify(docs, langid.fit(docs), names)
    return rated.filter((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest doc_id."""
    return jaccard.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: every document as often as it is taken."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: place, number and checksum of each document's ids, read back from the written files."""
    import public_tokenizers

    return tokens.tokens(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_ids),
]

#: Language, similarity and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
