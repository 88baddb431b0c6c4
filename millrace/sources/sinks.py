"""Writers: result log, deduplicated records, runs, series, CSV, manifests, tenant dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact_secrets
from ..operators.dedupe import first_per_key
from ..session import materialize, spread, with_scalar
from . import keyindex

RECORD_KEY = ["record_id", "profile_id"]


# text formats keep milliseconds only unless told otherwise
MICROS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def append_results(df: DataFrame, path: str, run_id: str, partition: str = "profile_id") -> None:
    """Append every record to the log, stamped with the run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy(partition).parquet(path)


def rejected_records(df: DataFrame) -> DataFrame:
    """Records that can't be stored, with the reason."""
    reason = F.when(F.col("record_id").isNull(), "no_record_id").when(F.col("profile_id").isNull(), "no_profile_id")
    return df.withColumn("reason", reason).where("reason is not null")


def insert_records(df: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """Insert the new records; returns one row with inserted, deduplicated and rejected counts.

    Rows without a key, such as unreadable documents, are rejected (``rejected_records`` returns them). Of the stored
    rows only those that may have a key of the batch are read, by the Bloom filters of ``keyindex``.
    """
    keyed = F.col("record_id").isNotNull() & F.col("profile_id").isNotNull()
    total = df.agg(F.count_if(keyed).alias("__n"), F.count_if(~keyed).alias("rejected"))
    fresh = materialize(keyindex.unseen(first_per_key(df.where(keyed), RECORD_KEY, order), path, RECORD_KEY))
    if not fresh.isEmpty():
        keyindex.append(fresh, path, RECORD_KEY)
    return with_scalar(fresh.agg(F.count("*").alias("inserted")), total).select("inserted", (F.col("__n") - F.col("inserted")).alias("deduped"), "rejected")


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """All records that were inserted."""
    return keyindex.rows_of(spark, path)


def upsert_runs(stored: DataFrame, incoming: DataFrame, seq: str) -> DataFrame:
    """Runs by id, the last write wins; secrets in error texts are masked."""
    safe = incoming.withColumn("error", redact_secrets(F.col("error")))
    return first_per_key(stored.unionByName(safe), ["run_id"], [seq], last=True)


def write_series(points: DataFrame, path: str, series: Sequence[str], tenant: str = "tenant_id", namespace: str = "namespace") -> None:
    """Sorted series files partitioned by tenant, namespace and day.

    The range shuffle covers series and time as well, so one busy tenant or day is written by many
    tasks, each with a contiguous and sorted slice.
    """
    order = [tenant, namespace, "day", *series, "ts"]
    dated = points.withColumn("day", F.to_date("ts"))
    (
        dated.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy(tenant, namespace, "day")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**MICROS).option("header", True).csv(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder with a text file per ``key``. The keys are dealt to all cores, and every task moves its own files into place.

    One scan task would write all files one after the other, and the driver would move them so, a folder at a time. Rows of a key
    always come to the same task, so a task that runs again writes the same files over.
    """
    dealt = spread(df.select(key, F.col(text).alias("value")), key)
    dealt.write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


#: Tasks that list the folders of a manifest; Spark's default is one per folder up to 10,000, each of which lasts longer to start than to list.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file below ``path``."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, 4 * spark.sparkContext.defaultParallelism)
    try:  # folders are listed by load
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    finally:
        spark.conf.set(LISTING, before)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_tenant(points: DataFrame, tenant: str, path: str) -> None:
    """Dump one tenant's feature points as JSON lines."""
    points.where(F.col("tenant_id") == tenant).write.mode("overwrite").options(**MICROS).json(path)


def import_tenant(stored: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Points of a dump that are not stored yet."""
    dumped = stored.sparkSession.read.schema(stored.schema).options(**MICROS).json(path)
    return dumped.join(stored.select(*key), list(key), "left_anti")
