"""Scans and readers: stored results, payload files, feeds, databases, object stores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(df: DataFrame, equals: Mapping[str, object], ts: str, tie: str, limit: int | None = 100) -> DataFrame:
    """Rows matching the given columns, the newest ``limit`` of them first; all of them, unordered, for None.

    Filters with no value are left out, so the rest reach the file scan.
    """
    for column, value in equals.items():
        if value not in (None, ""):
            df = df.where(F.col(column) == F.lit(value))
    return df if limit is None else df.orderBy(F.desc(ts), F.asc(tie)).limit(limit)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def read_json_batch(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON documents, one per file or per line: the parsed ones as ``payload`` with their hash, and the broken ones."""
    files = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    files = files.withColumn("payload_sha256", F.sha2("payload", 256))
    good = F.try_parse_json("payload").isNotNull()
    return files.where(good), files.where(~good)


SERIES_KEY = (
    "struct<tenant_id:string,namespace:string,metric:string,entity_type:string,entity_id:string,tags:map<string,string>>"
)
TS_PAYLOAD = (
    f"struct<meta:map<string,string>,series:array<struct<key:{SERIES_KEY},"
    "points:array<struct<ts:string,value:double,meta:map<string,string>>>>>>"
)


def split_ts_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series payloads (column ``value``) as one row per point, and what can't be one, with a reason.

    Points carry their key and the payload's hash. A payload is rejected as a whole when it is no JSON
    object or has an unknown field; a point when its time or value is missing or can't be read.
    """
    hashed = payloads.select(F.sha2("value", 256).alias("payload_sha256"), "value")
    known = F.json_object_keys("value")
    reason = F.when(known.isNull() | F.try_parse_json("value").isNull(), "not_an_object").when(
        F.size(F.array_except(known, F.array(F.lit("meta"), F.lit("series")))) > 0, "unknown_field"
    )
    judged = hashed.withColumn("reason", reason)
    parsed = judged.where("reason is null").select("payload_sha256", F.from_json("value", TS_PAYLOAD).alias("p"))
    series = parsed.select("payload_sha256", F.explode("p.series").alias("s"))
    points = series.select("payload_sha256", "s.key.*", F.explode("s.points").alias("pt")).withColumn("ts", F.try_to_timestamp("pt.ts").cast("timestamp_ntz"))
    bad = F.when(F.col("ts").isNull(), "bad_time").when(F.col("pt.value").isNull() | F.isnan("pt.value"), "bad_value")
    points = points.withColumn("reason", bad)
    good = points.where("reason is null").withColumns({"value": F.col("pt.value"), "meta": F.col("pt.meta")}).drop("pt", "reason")
    rejected = judged.where("reason is not null").select("payload_sha256", "reason", F.col("value").alias("content"))
    return good, rejected.unionByName(points.where("reason is not null").select("payload_sha256", "reason", F.to_json("pt").alias("content")))


def read_ts_payload(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Series payload files, plain or gzip: one payload per file, or per line. Points and rejected parts."""
    return split_ts_payload(spark.read.text(path, wholetext=not lines).select("value"))


RSS = "struct<channel:struct<title:string,item:array<struct<title:string,link:string,pubDate:string>>>>"


def read_feeds(feeds: DataFrame, xml: str, items: int | None = None) -> DataFrame:
    """Title and link of the entries of stored RSS documents, of the first ``items`` of each if given."""
    keys = [c for c in feeds.columns if c != xml]
    parsed = feeds.select(*keys, F.from_xml(xml, RSS).alias("r"))
    first = F.col("r.channel.item") if items is None else F.slice("r.channel.item", 1, items)
    return parsed.select(*keys, F.posexplode(first).alias("pos", "i")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.trim("i.title").alias("title"), F.trim("i.link").alias("link")
    )


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, **options: str) -> DataFrame:
    """A database table. For large tables give a partition column with its bounds and count."""
    if not url.startswith("jdbc:"):
        raise ValueError("a JDBC url is required")
    if not table.strip():
        raise ValueError("a table is required")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        missing = {"lowerBound", "upperBound", "numPartitions"} - options.keys()
        if missing:
            raise ValueError(f"partitioned read needs {sorted(missing)}")
        reader = reader.option("partitionColumn", partition_column)
    return reader.options(**options).load()


FORMATS = ("parquet", "orc", "json", "csv", "text", "avro", "binaryFile")


def read_object(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Files of an object store or file system by their path scheme (``s3a://``, ``gs://``, ``file:``)."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)
