"""Names and small expressions that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, the same in Spark, Python and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column = "text") -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def widened(df: DataFrame) -> DataFrame:
    """Parquet of ``df`` can be read in fewer, larger tasks; this deals its rows over all cores evenly."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that have been written and are no longer referenced.

    The cleaner acts on what the driver's collector finds; between the large steps of one job this keeps the
    disk at the size of a step, not of the job.
    """
    spark.sparkContext._jvm.System.gc()
