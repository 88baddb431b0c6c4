"""A record table whose inserts look only at stored rows that may hold their keys.

Every batch is a folder of its own. Its rows are dealt into cells by a hash of the key, about ``PER_CELL`` rows each; a cell has a Bloom
filter of one bitmap in the table's key index, and ``CELLS`` cells share a file folder, sorted by cell. An insert finds the cell of
each of its keys in every batch by an equi-join with the index, tests the key's bits there, and reads only the folders of the
cells that pass, where the keys themselves are compared. Batches of one size class have as many cells, so a key meets an index row per
batch, not per stored key.

The index of a batch is written before its rows. After a failure in between it names a folder that isn't there, which is skipped;
the next insert of the same rows stores them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

PER_CELL = 3000
CELLS = 32
#: Bits of a cell's filter (the size of Spark's bitmaps) and bits per key.
BITS, HASHES = 32768, 5
INDEX = "_keys"
OWN = ("__batch", "__folder", "__cell")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _cell(key: Sequence[str], cells: Column) -> Column:
    return F.pmod(F.xxhash64(*key), cells)


def _bits(key: Sequence[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(BITS)).cast("int") for i in range(1, HASHES + 1)]


def _holds(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, bit.bitwiseAND(7)).bitwiseAND(1) == 1


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows."""
    return spark.read.parquet(path).drop(*OWN)


def append(rows: DataFrame, path: str, key: Sequence[str]) -> str:
    """Store rows whose keys are new, and their index; returns the name of the batch."""
    batch, n = uuid.uuid4().hex, rows.count()
    cells = 1
    while cells * PER_CELL < n:
        cells *= 2
    placed = rows.withColumn("__cell", _cell(key, F.lit(cells).cast("long"))).withColumn("__folder", F.floor(F.col("__cell") / CELLS))
    marks = placed.select("__cell", F.explode(F.array(*_bits(key))).alias("bit"))
    index = marks.groupBy(F.col("__cell").alias("cell")).agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    index = index.select(F.lit(batch).alias("batch"), F.lit(cells).cast("long").alias("cells"), "cell", "bitmap")
    index.sort("cell").write.mode("append").parquet(f"{path}/{INDEX}")
    dealt = placed.repartition("__folder").sortWithinPartitions("__folder", "__cell")
    dealt.write.partitionBy("__folder").parquet(f"{path}/__batch={batch}")
    return batch


def hits(keys: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """(key, batch, cell, folder): the cells whose filter does not rule the key out."""
    spark = keys.sparkSession
    index = spark.read.schema("batch string, cells long, cell long, bitmap binary").parquet(f"{path}/{INDEX}")
    sizes = [r["cells"] for r in index.select("cells").distinct().collect()]  # powers of two: a few dozen at most
    bits = [b.alias(f"__bit{i}") for i, b in enumerate(_bits(key))]
    spots = keys.select(*key, *bits, F.explode(F.array(*[F.struct(F.lit(c).alias("cells"), _cell(key, F.lit(c)).alias("cell")) for c in sizes])).alias("s"))
    spots = spots.select(*key, *[f"__bit{i}" for i in range(HASHES)], "s.cells", "s.cell")
    possible = F.lit(True)
    for i in range(HASHES):
        possible = possible & _holds(F.col("bitmap"), F.col(f"__bit{i}"))
    return spots.join(index, ["cells", "cell"]).where(possible).select(*key, "batch", "cell", F.floor(F.col("cell") / CELLS).alias("folder"))


def candidates(keys: DataFrame, path: str, key: Sequence[str]) -> DataFrame | None:
    """The stored rows that may hold one of the keys: what an insert reads."""
    spark = keys.sparkSession
    if not exists(spark, f"{path}/{INDEX}"):
        return None
    found = hits(keys, path, key).select("batch", "folder").distinct().collect()  # names of folders to read
    folders = [f for f in (f"{path}/__batch={r['batch']}/__folder={r['folder']}" for r in found) if exists(spark, f)]
    return spark.read.option("basePath", path).parquet(*folders) if folders else None


def unseen(rows: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """The rows whose key is not stored yet."""
    rows = materialize(rows)
    stored = candidates(rows.select(*key), path, key)
    return rows if stored is None else rows.join(stored.select(*key), list(key), "left_anti")
