"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on.

    On a cluster pass no master: ``spark-submit`` supplies it, and shuffle width is left to the
    cluster's own configuration plus adaptive coalescing.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, on storage that all executors share; gone with the session."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the written copy.

    Used where a later step must see the very same rows twice (positions taken from a range
    shuffle, the rounds of an iterative fold): the copy survives the loss of executors. A written
    table, unlike ``checkpoint``, also gives the planner its true size, so joins of small results
    are broadcast, and later readers prune its columns.
    """
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files for a task of heavy work.
PIECE = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of files, by hash of ``keys``, to as many tasks as there are cores, or one for ``PIECE`` bytes of the files if that is more.

    For work that is heavy per row. The tasks of a scan tell little: a row group is read by one of them whole, however many are planned.
    """
    sc = df.sparkSession.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    size = sum(p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(max(sc.defaultParallelism, -(-size // PIECE)), *keys)


def on_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the columns of ``left``, then the others of ``right``."""
    renamed = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__same_{k}"))
    return left.join(renamed, same, how).drop(*[f"__same_{k}" for k in keys])


def join_small(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``on_same`` with a right side that is expected to be small: it is written first.

    The planner then knows its bytes before it plans the join, broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold``, and the left side is not shuffled. A larger one is joined by a shuffle.
    """
    return on_same(left, materialize(right), keys, how)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row."""
    key = "__one"
    return df.withColumn(key, F.lit(1)).join(F.broadcast(one_row.limit(1).withColumn(key, F.lit(1))), key).drop(key)
