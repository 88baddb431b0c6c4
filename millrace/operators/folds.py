"""Sequential recurrences over long series, run block by block in parallel.

A recurrence such as an exponential level needs the state left by the row before. Folding a whole
series in one task does not scale to a hot series, so the series is packed into blocks of
``BLOCK`` rows and the state at each block's start is found first:

* **Linear recurrences** (exponential smoothing in all its forms): the state after a block is
  ``A @ state + b``. ``A`` depends only on the block's length and season phase, ``b`` is the block
  folded from a zero state. Chaining the (A, b) pairs gives every entry state; where a series has
  more than ``FAN`` blocks the pairs are first combined in groups, and those groups again.
* **Recurrences with resets** (CUSUM, Page-Hinkley) and hash chains do not combine that way. Each
  stretch of ``STRETCH`` blocks is folded from a guessed entry state, its blocks one after the other;
  stretches whose predecessor ended in another state than guessed are folded again, until nothing
  changes. Where resets make neighbouring paths meet two or three rounds are usual; the mean of Page-Hinkley
  never meets without an alarm, and then every round settles one more stretch per series.
  The settled result equals the row-by-row fold exactly.

A block is one row with an array of values, bounded by ``BLOCK``; Python sees one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_small, materialize, on_same, scratch

BLOCK = 4096
FAN = 4096
# blocks that one task folds one after the other in a round of ``settle``
STRETCH = 256

# step(values, start, state, params) -> (state after the block, list of output columns)
Step = Callable[[np.ndarray, int, list, list], tuple[list, list]]


def pack_blocks(indexed: DataFrame, keys: Sequence[str], carry: Sequence[str] = ("ts",), block: int = BLOCK) -> DataFrame:
    """One row per (series, block): ``start`` position, ``v`` values and the carried columns as arrays."""
    fields = ["idx", "value", *carry]
    packed = (
        indexed.withColumn("blk", F.floor(F.col("idx") / F.lit(block)).cast("bigint"))
        .groupBy(*keys, "blk")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    )
    return packed.select(
        *keys,
        "blk",
        F.col("rows")[0]["idx"].alias("start"),
        F.size("rows").cast("bigint").alias("n"),
        F.col("rows.value").alias("v"),
        *[F.col(f"rows.{c}").alias(c) for c in carry],
    )


def _blocks_of(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple]:
    """Per block of a batch its arrays ``columns``, then start, entry state and parameters."""
    for row in range(batch.num_rows):
        start, entry, params = (batch.column(c)[row].as_py() for c in ("start", "entry", "params"))
        yield [batch.column(c)[row].values for c in columns], start, entry, params


def _states(entered: DataFrame, keys: Sequence[str], step: Step, more: Sequence[str] = ()) -> DataFrame:
    """``entry`` and ``exit`` state of every block: a small row per block, the fold's output columns stay where they are.

    A block with a NULL ``entry`` goes on from the block before it, so its task must have both, in order.
    """
    kept = [*keys, "blk", *more]
    state = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for batch in batches:
            entries, exits = [], []
            for (v,), start, entry, params in _blocks_of(batch, ["v"]):
                entries.append(end if entry is None else entry)
                end = [float(x) for x in step(v.to_numpy(zero_copy_only=False), start, entries[-1], params)[0]]
                exits.append(end)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(entries, state), pa.array(exits, state)], [*kept, "entry", "exit"])

    read = [*kept, *[c for c in ("start", "v", "entry", "params") if c not in kept]]
    return entered.select(*read).mapInArrow(run, f"{_ddl(entered, kept)}, entry array<double>, exit array<double>")


def _rows(entered: DataFrame, keys: Sequence[str], carry: Sequence[str], outputs: Sequence[str], step: Step) -> DataFrame:
    """One row per point with the fold's output columns, from blocks with their ``entry``.

    A block goes out as flat columns before the next is folded, so Python holds the output of one block only, however many a task has.
    """
    keys, carry, outputs = list(keys), list(carry), list(outputs)
    names = [*keys, "idx", "value", *carry, *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (arrays, start, entry, params) in enumerate(_blocks_of(batch, ["v", *carry])):
                v, n = arrays[0], len(arrays[0])
                if not n:
                    continue
                _, out = step(v.to_numpy(zero_copy_only=False), start, entry, params)
                at = pa.array(np.full(n, row))
                idx = pa.array(np.arange(start, start + n, dtype="int64"))
                filled = [pa.array(np.asarray(o, dtype=float)) for o in out[: len(outputs)]]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], idx, *arrays, *filled], names)

    types = dict(entered.dtypes)
    carried = [f"`{c}` {types[c][len('array<') : -1]}" for c in carry]
    schema = ", ".join([_ddl(entered, keys), "idx bigint", "value double", *carried, *[f"`{o}` double" for o in outputs]])
    return entered.select(*keys, "start", "v", *carry, "entry", "params").mapInArrow(run, schema)


def _chain(spans: DataFrame, keys: list[str], matrix: Callable[[int, int], np.ndarray], fan: int, longest: int) -> DataFrame:
    """Entry state of every span from the spans' (start, n, b); spans of one key are numbered by ``blk``."""
    schema = f"{_ddl(spans, keys)}, blk bigint, entry array<double>"

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        given = pdf["given"].iloc[0] if "given" in pdf else None
        state = np.zeros(len(pdf["b"].iloc[0])) if given is None else np.asarray(given, dtype=float)
        entries = []
        for start, n, b in zip(pdf["start"], pdf["n"], pdf["b"], strict=True):
            entries.append(state.tolist())
            state = matrix(int(start), int(n)) @ state + np.asarray(b)
        out = pdf[[*keys, "blk"]].copy()
        out["entry"] = entries
        return out

    if longest < fan:
        return spans.groupBy(*keys).applyInPandas(scan, schema)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        b = np.zeros(len(pdf["b"].iloc[0]))
        for start, n, part in zip(pdf["start"], pdf["n"], pdf["b"], strict=True):
            b = matrix(int(start), int(n)) @ b + np.asarray(part)
        head = pdf.iloc[:1]
        out = head[keys].copy()
        out["blk"] = int(head["blk"].iloc[0]) // fan
        out["start"], out["n"], out["b"] = int(head["start"].iloc[0]), int(pdf["n"].sum()), [b.tolist()]
        return out

    # the levels read the spans twice, so they are written once
    grouped = materialize(spans).withColumn("__g", F.floor(F.col("blk") / F.lit(fan)).cast("bigint"))
    wide = f"{_ddl(spans, keys)}, blk bigint, start bigint, n bigint, b array<double>"
    upper = grouped.groupBy(*keys, "__g").applyInPandas(combine, wide)
    above = _chain(upper, keys, matrix, fan, longest // fan).withColumnsRenamed({"blk": "__g", "entry": "given"})
    return on_same(grouped, above, [*keys, "__g"]).groupBy(*keys, "__g").applyInPandas(scan, schema)


def _ddl(df: DataFrame, columns: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def _started(
    indexed: DataFrame, keys: list[str], initial: DataFrame, carry: Sequence[str], block: int, written: DataFrame | None
) -> DataFrame:
    """Packed blocks with their start state; rows before ``first`` are cut off the opening block.

    The start states meet the blocks, not the rows, so the join moves one row per block. ``written`` are the blocks
    themselves, where the caller has written them for several folds; otherwise the blocks are packed and written here.
    """
    blocks = pack_blocks(indexed, keys, carry, block) if written is None else written
    packed = join_small(blocks.select(*keys, "blk", "start", "n", "v", *carry), initial, keys)
    skip = F.greatest(F.col("first") - F.col("start"), F.lit(0)).cast("int")
    cut = lambda c: F.when(skip > 0, F.slice(c, skip + 1, F.greatest(F.size(c) - skip, F.lit(0)))).otherwise(F.col(c))
    kept = packed.where(F.col("start") + F.col("n") > F.col("first"))
    started = kept.withColumns(
        {c: cut(c) for c in ("v", *carry)} | {"start": F.col("start") + skip, "n": F.col("n") - skip}
    )
    return materialize(started) if written is None else started


def linear_fold(
    indexed: DataFrame,
    keys: Sequence[str],
    step: Step,
    matrix: Callable[[int, int], np.ndarray],
    initial: DataFrame,
    width: int,
    outputs: Sequence[str],
    carry: Sequence[str] = ("ts",),
    block: int = BLOCK,
    fan: int = FAN,
    written: DataFrame | None = None,
) -> DataFrame:
    """Fold every series; ``initial`` has keys, ``state`` (before the first row), ``params`` and ``first``.

    ``first`` is the position the fold starts at; earlier rows are left out.
    """
    keys = list(keys)
    packed = _started(indexed, keys, initial, carry, block, written)
    opening = F.col("start") == F.col("first")
    zero = F.array_repeat(F.lit(0.0), width)
    longest, followers = packed.agg(F.max("blk"), F.count_if(~opening)).first()
    if not followers:
        entered = packed.withColumn("entry", F.col("state"))
    else:
        local = packed.withColumn("entry", F.when(opening, F.col("state")).otherwise(zero))
        spans = _states(local, keys, step, ["start", "n"]).select(*keys, "blk", "start", "n", F.col("exit").alias("b"))
        entered = join_small(packed, _chain(spans, keys, matrix, fan, longest), [*keys, "blk"]).withColumn(
            "entry", F.when(opening, F.col("state")).otherwise(F.col("entry"))
        )
    return _rows(entered, keys, carry, outputs, step)


def settle(packed: DataFrame, keys: Sequence[str], entered: DataFrame, states: Callable[[DataFrame], DataFrame], stretch: int = 1) -> DataFrame:
    """Fold blocks until every block's entry state is the state its predecessor ended in; returns keys, ``blk`` and that ``entry``.

    ``packed`` has keys and ``blk``; ``entered`` are those of its rows that are folded first, with a guessed ``entry``.
    ``stretch`` blocks are folded one after the other in a round; only the first of them has an entry, the others have NULL.
    ``states`` gives keys, ``blk``, ``entry`` and ``exit`` of packed rows with their entry.
    Blocks without an entry yet wait for their predecessor. The rounds keep states
    only, one row per block; the caller folds once more from the settled ``entry`` for the output.
    """
    keys = list(keys)
    at = [*keys, "blk"]
    run = F.floor(F.col("blk") / F.lit(stretch)).cast("bigint")

    spark, path, rounds = packed.sparkSession, scratch(packed.sparkSession, "rounds"), 0

    def fold(rows: DataFrame) -> DataFrame:
        """Fold some blocks and append their states as the next round; returns that round alone."""
        nonlocal rounds
        folded = states(rows).select(*at, "entry", "exit")
        folded.write.parquet(f"{path}/round={rounds}")
        rounds += 1
        return spark.read.schema(folded.schema).parquet(f"{path}/round={rounds - 1}")

    def settled() -> DataFrame:
        """The state of the last round that folded each block."""
        every = spark.read.option("basePath", path).parquet(path)
        return every.groupBy(*at).agg(F.max_by("entry", "round").alias("entry"))

    waiting = packed.select(*at)
    done = fold(entered)
    while True:
        # only what was folded in the last round can pass on something new
        ends = done.where(F.pmod(F.col("blk") + 1, F.lit(stretch)) == 0)
        passed = ends.select(*keys, (F.col("blk") + 1).alias("blk"), F.col("exit").alias("__new"))
        known = settled()
        todo = materialize(
            on_same(on_same(passed, waiting, at), known, at, "left")
            .where(~F.col("__new").eqNullSafe(F.col("entry")))
            .select(*at, F.col("__new").alias("entry"))
        )
        if todo.limit(1).count() == 0:
            return settled()
        # what is to be folded again is small and written: it goes to the blocks, which stay where they are
        again = todo.withColumn("__run", run).withColumnRenamed("blk", "__at")
        rows = on_same(packed.withColumn("__run", run), again, [*keys, "__run"])
        done = fold(rows.withColumn("entry", F.when(F.col("blk") == F.col("__at"), F.col("entry"))))


def reset_fold(
    indexed: DataFrame,
    keys: Sequence[str],
    step: Step,
    initial: DataFrame,
    outputs: Sequence[str],
    guess: Column | None = None,
    carry: Sequence[str] = ("ts",),
    block: int = BLOCK,
    written: DataFrame | None = None,
    stretch: int = STRETCH,
) -> DataFrame:
    """Fold with resets; ``guess`` is the entry state tried first for stretches after the opening one."""
    keys = list(keys)
    packed = _started(indexed, keys, initial, carry, block, written)
    opening = F.col("start") == F.col("first")
    guessed = F.col("state") if guess is None else F.when(opening, F.col("state")).otherwise(guess)
    run = F.floor(F.col("blk") / F.lit(stretch)).cast("bigint")
    heads = opening | (F.pmod("blk", F.lit(stretch)) == 0)
    entered = packed.withColumn("entry", F.when(heads, guessed))

    def states(rows: DataFrame) -> DataFrame:
        """The blocks of a stretch one after the other in one task, which holds the state of the last."""
        dealt = rows.select(*keys, "blk", "start", "v", "entry", "params").withColumn("__run", run)
        return _states(dealt.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", "blk"), keys, step)

    settled = settle(packed, keys, entered, states, stretch)
    return _rows(join_small(packed, settled, [*keys, "blk"]), keys, carry, outputs, step)


# --- the recurrences -------------------------------------------------------------------------


def level_step(alpha: float) -> Step:
    def step(v, start, state, params):
        level, levels = state[0], []
        for x in v.tolist():
            level = alpha * x + (1 - alpha) * level
            levels.append(level)
        return [level], [levels]

    return step


def level_matrix(alpha: float):
    return lambda start, n: np.array([[(1 - alpha) ** n]])


def trend_step(alpha: float, beta: float) -> Step:
    def step(v, start, state, params):
        level, trend = state
        levels, trends = [], []
        for x in v.tolist():
            before = level
            level = alpha * x + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
            levels.append(level)
            trends.append(trend)
        return [level, trend], [levels, trends]

    return step


def trend_matrix(alpha: float, beta: float):
    keep = np.array([[1 - alpha, 1 - alpha], [-alpha * beta, beta * (1 - alpha) + 1 - beta]])
    return lambda start, n: np.linalg.matrix_power(keep, n)


def seasonal_step(alpha: float, beta: float, gamma: float, p: int, ahead: int) -> Step:
    """Level, trend and the seasonal terms of the next ``ahead`` rows (at most ``p``), after each row.

    A row's term is the one that the row ``p`` before it has set, so the terms ahead are the series of set terms, lagged.
    """

    def step(v, start, state, params):
        level, trend = state[0], state[1]
        # the terms set by the p rows before the block, then by its own
        terms = [state[2 + (start + i) % p] for i in range(p)]
        levels, trends = [], []
        for i, x in enumerate(v.tolist()):
            before, s = level, terms[i]
            level = alpha * (x - s) + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
            terms.append(gamma * (x - level) + (1 - gamma) * s)
            levels.append(level)
            trends.append(trend)
        n = len(levels)
        end = [terms[n + (phase - start - n) % p] for phase in range(p)]
        every = np.asarray(terms)
        return [level, trend, *end], [levels, trends, *[every[j : j + n] for j in range(1, ahead + 1)]]

    return step


class SeasonalMatrix:
    """The matrix of ``n`` steps from phase ``start % p``: unit states folded over zero inputs."""

    def __init__(self, alpha: float, beta: float, gamma: float, p: int):
        self.step = seasonal_step(alpha, beta, gamma, p, 0)
        self.p = p
        self.known: dict = {}

    def __call__(self, start: int, n: int) -> np.ndarray:
        at = (start % self.p, n)
        if at not in self.known:
            seasons, rest = divmod(n, self.p)
            whole = np.linalg.matrix_power(self._fold(at[0], self.p), seasons)
            self.known[at] = self._fold(at[0], rest) @ whole
        return self.known[at]

    def _fold(self, phase: int, n: int) -> np.ndarray:
        columns = [self.step(np.zeros(n), phase, unit.tolist(), [])[0] for unit in np.eye(self.p + 2)]
        return np.array(columns).T


def cusum_step(v, start, state, params):
    """Two one-sided sums around the warm-up mean; each side restarts alone. params: mu, k, h."""
    high, low = state
    mu, k, h = params[0], params[1], params[2]
    up, down = [], []
    for x in v.tolist():
        high = max(0.0, high + (x - mu - k))
        low = min(0.0, low + (x - mu + k))
        up.append(high / h if high > h else 0.0)
        down.append(-low / h if -low > h else 0.0)
        high = 0.0 if high > h else high
        low = 0.0 if -low > h else low
    return [high, low], [up, down]


def drift_step(delta: float, limit: float) -> Step:
    """Page-Hinkley: running mean and the excess of the cumulative sum over its minimum.

    After an alarm the mean restarts at the current value while its divisor goes on counting rows
    from the start of the series.
    """

    def step(v, start, state, params):
        mean, excess = state
        scores = []
        for i, x in enumerate(v.tolist(), start):
            mean = mean + (x - mean) / (i + 1)
            excess = max(0.0, excess + (x - mean - delta))
            if excess > limit:
                scores.append(excess / limit)
                mean, excess = x, 0.0
            else:
                scores.append(0.0)
        return [mean, excess], [scores]

    return step


def alarm_step(delta: float, limit: float) -> Step:
    """CUSUM and Page-Hinkley over the same values. state: that of CUSUM, then that of Page-Hinkley; params: mu, k, h
    and the position CUSUM starts at. Page-Hinkley starts at the second row."""
    drift = drift_step(delta, limit)

    def step(v, start, state, params):
        warm, second = min(max(int(params[3]) - start, 0), len(v)), min(max(1 - start, 0), len(v))
        sums, sides = cusum_step(v[warm:], start + warm, state[:2], params)
        drifted, (scores,) = drift(v[second:], start + second, state[2:], [])
        return [*sums, *drifted], [*[[0.0] * warm + side for side in sides], [0.0] * second + scores]

    return step
