"""Row positions, blocks and halos for long series.

A window partitioned by series puts a whole series into one task. With a third of all rows in one
series that task never ends. The helpers here keep the results of such windows while no task holds
more than a bounded block:

* ``with_position`` numbers the rows of every series from a range shuffle over (series, order), so
  a hot series is spread over as many tasks as its size asks for;
* ``with_halo`` cuts the numbered rows into blocks and copies the edge rows a frame needs into the
  neighbouring block;
* ``with_running`` adds running totals from per-block totals plus a window inside the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize

BLOCK_ROWS = 1 << 18


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Add the zero-based position of each row inside its key under a total ``order``.

    ``monotonically_increasing_id`` over the sorted range partitions gives (partition, offset); the
    first id and the row count of each (key, partition) turn that into a position. Rows with a NULL key are a key of their own. The sorted rows
    are written once, so both readings see the same partitions.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = materialize(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__slot", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__slot", 33))
    )
    pieces = placed.groupBy(*keys, "__part").agg(F.min("__slot").alias("__first"), F.count("*").alias("__n"))
    # one row per (key, partition): small by construction, so a window per key is safe here
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *keys, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    return (
        join_small(placed, offsets, [*keys, "__part"])
        .withColumn(name, F.col("__slot") + F.col("__shift"))
        .drop("__slot", "__part", "__shift")
    )


def with_halo(
    df: DataFrame, idx: str = "idx", before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``__blk`` and ``__own``; every block also sees ``before`` earlier and ``after`` later rows.

    Window over (series, __blk), then keep ``__own`` rows: the frames are complete.
    """
    step = F.lit(block_rows).cast("bigint")
    home = F.floor(F.col(idx) / step).cast("bigint")
    low = F.floor(F.greatest(F.col(idx) - F.lit(after), F.lit(0)) / step).cast("bigint")
    high = F.floor((F.col(idx) + F.lit(before)) / step).cast("bigint")
    return df.withColumn("__blk", F.explode(F.sequence(low, high))).withColumn("__own", F.col("__blk") == home)


def block_window(keys: Sequence[str], idx: str = "idx"):
    return Window.partitionBy(*keys, "__blk").orderBy(idx)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__blk", "__own")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    totals: dict[str, Column],
    idx: str = "idx",
    block_rows: int = BLOCK_ROWS,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums of the given expressions inside each key, in ``idx`` order.

    Each block is summed on its own; the totals of the earlier blocks (one row per block) are
    added. ``inclusive=False`` leaves the current row out.
    """
    keys = list(keys)
    names = list(totals)
    blocked = df.withColumn("__blk", F.floor(F.col(idx) / F.lit(block_rows)).cast("bigint"))
    for name, expr in totals.items():
        blocked = blocked.withColumn(f"__{name}", expr)
    per_block = blocked.groupBy(*keys, "__blk").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, "__blk", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}_0") for n in names]
    )
    inside = Window.partitionBy(*keys, "__blk").orderBy(idx)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    summed = blocked.withColumns({f"__{n}": F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) for n in names})
    out = join_small(summed, carried, [*keys, "__blk"])
    sums = [(F.col(f"__{n}") + F.col(f"__{n}_0")).alias(n) for n in names]
    return out.select(*[c for c in df.columns if c not in names], *sums)


def with_previous(df: DataFrame, keys: Sequence[str], columns: Sequence[str], idx: str = "idx", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``prev_<column>``: the value one position earlier in the key, NULL on the first row."""
    haloed = with_halo(df, idx, before=1, block_rows=block_rows)
    w = block_window(keys, idx)
    for c in columns:
        haloed = haloed.withColumn(f"prev_{c}", F.lag(c).over(w))
    return own_rows(haloed)
