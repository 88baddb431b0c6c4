"""Anomaly detectors over numbered series (see ``series.positioned``).

Every detector returns one row per flagged point: the keys, ``idx``, ``ts``, ``value``, ``score``,
``method`` and ``direction``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize, on_same

from . import folds
from .positions import BLOCK_ROWS, block_window, own_rows, with_halo, with_running


@dataclass(frozen=True)
class AnomalyConfig:
    window: int = 30
    threshold: float = 3.0
    min_points: int = 12
    warmup: int | None = None
    season_length: int = 0
    ewma_alpha: float = 0.2
    control_l: float = 3.0
    ph_delta: float = 0.005
    ph_lambda: float = 5.0
    cusum_k: float | None = None
    cusum_h: float | None = None
    block_rows: int = BLOCK_ROWS
    fold_block: int = folds.BLOCK

    @property
    def warm(self) -> int:
        return max(3, self.warmup or max(8, self.window))


FINDING = ("idx", "ts", "value", "score", "method", "direction")
TINY = 1e-12
# when a detector flags a row, with what score and direction
Terms = tuple[Column, Column, Column]


def _sign(x: Column) -> Column:
    return F.when(x > 0, "high").when(x < 0, "low").otherwise("change")


def prior_window(indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    """Count, mean and deviation of the ``window`` rows before each row."""
    haloed = with_halo(indexed, before=cfg.window, block_rows=cfg.block_rows)
    w = block_window(keys).rowsBetween(-cfg.window, -1)
    stats = haloed.select(
        "*",
        F.count("value").over(w).alias("__n"),
        F.avg("value").over(w).alias("__mean"),
        F.stddev_pop("value").over(w).alias("__std"),
    )
    return own_rows(stats)


def _findings(df: DataFrame, keys: Sequence[str], method: str, score: Column, direction: Column) -> DataFrame:
    return df.select(
        *keys, "idx", "ts", "value", score.alias("score"), F.lit(method).alias("method"), direction.alias("direction")
    )


def zscore_terms(cfg: AnomalyConfig) -> Terms:
    z = F.try_divide(F.col("value") - F.col("__mean"), F.col("__std"))
    return (F.col("__n") >= 3) & (F.col("__std") > TINY) & (F.abs(z) >= cfg.threshold), F.abs(z), _sign(z)


def zscore(stats: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    hit, score, direction = zscore_terms(cfg)
    return _findings(stats.where(hit), keys, "rolling_zscore", score, direction)


def medians(ordered: np.ndarray, low: int, n: int) -> np.ndarray:
    """Median of ``n`` columns from ``low`` on, per row of sorted windows."""
    return (ordered[:, low + (n - 1) // 2] + ordered[:, low + n // 2]) / 2


ORDER = ("n", "med", "mad", "q1", "q3")
MOMENTS = ("mean", "std")


def order_statistics(v: np.ndarray, own: int, window: int, moments: bool = False) -> np.ndarray:
    """``ORDER``: count, median, MAD and Tukey quartiles of the window before each of the last ``own`` values; and ``MOMENTS``."""
    out = np.full((7 if moments else 5, own), np.nan)
    out[0] = 0
    offset = len(v) - own

    def fill(windows: np.ndarray, at: slice) -> None:
        n = windows.shape[1]
        ordered = np.sort(windows, axis=1)
        med = medians(ordered, 0, n)
        gaps = np.sort(np.abs(windows - med[:, None]), axis=1)
        half = n // 2
        low, high = (medians(ordered, 0, half), medians(ordered, n - half, half)) if half else (med, med)
        out[:5, at] = [np.full(len(med), n), med, medians(gaps, 0, n), low, high]
        if moments:
            out[5:, at] = [windows.mean(axis=1), windows.std(axis=1)]

    # only the head of a series has shorter windows
    head = min(max(window - offset, 0), own)
    for i in range(head):
        if offset + i:
            fill(v[None, : offset + i], slice(i, i + 1))
    if own > head:
        begin = offset + head - window
        fill(np.lib.stride_tricks.sliding_window_view(v[begin : len(v) - 1], window), slice(head, own))
    return out


def window_blocks(indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    """Blocks as ``folds.pack_blocks`` makes them, with ``head``: the up to ``window`` values before the block."""
    haloed = with_halo(indexed, before=cfg.window, block_rows=cfg.fold_block)
    rows = F.sort_array(F.collect_list(F.struct("idx", "value", "ts", "__own")))
    packed = haloed.groupBy(*keys, "__blk").agg(rows.alias("r"))
    own, head = F.filter("r", lambda x: x["__own"]), F.filter("r", lambda x: ~x["__own"])
    split = packed.select(*keys, F.col("__blk").alias("blk"), own.alias("own"), head["value"].alias("head")).where(F.size("own") > 0)
    return split.select(
        *keys, "blk", F.col("own")[0]["idx"].alias("start"), F.size("own").cast("bigint").alias("n"), F.col("own.value").alias("v"), F.col("own.ts").alias("ts"), "head"
    )


def block_statistics(blocks: DataFrame, keys: Sequence[str], cfg: AnomalyConfig, moments: bool = False) -> DataFrame:
    """Statistics of the ``window`` rows before each row, sorted block-wise with numpy, from ``window_blocks``."""
    window, names = cfg.window, (*ORDER, *MOMENTS) if moments else ORDER

    def run(head: pd.Series, v: pd.Series) -> pd.DataFrame:
        every = [(np.concatenate([np.asarray(h, dtype=float), np.asarray(a, dtype=float)]), len(a)) for h, a in zip(head, v, strict=True)]
        stats = [order_statistics(a, n, window, moments) for a, n in every]
        return pd.DataFrame({c: [s[i] for s in stats] for i, c in enumerate(names)})

    kind = "struct<" + ",".join(f"{c}:array<double>" for c in names) + ">"
    done = blocks.withColumn("s", F.pandas_udf(run, kind)("head", "v"))
    zipped = F.arrays_zip("v", "ts", *[F.col(f"s.{c}").alias(c) for c in names])
    # the outer form keeps the planner from sorting once more to filter empty blocks
    return done.select(*keys, "start", F.posexplode_outer(zipped).alias("p", "z")).where("z is not null").select(
        *keys, (F.col("start") + F.col("p")).alias("idx"), "z.ts", F.col("z.v").alias("value"), *[F.col(f"z.{c}").alias(f"__{c}") for c in names]
    )


def robust_window(indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    """Order statistics of the ``window`` rows before each row.

    A block is one row with its values and the ``window`` values before it.
    """
    return block_statistics(window_blocks(indexed, keys, cfg), keys, cfg)


def mad_terms(cfg: AnomalyConfig) -> Terms:
    # 0.6745 is the normal quantile that makes the MAD comparable to a deviation
    z = F.try_divide(F.lit(0.6745) * (F.col("value") - F.col("__med")), F.col("__mad"))
    return (F.col("__n") >= 5) & (F.col("__mad") > TINY) & (F.abs(z) >= cfg.threshold), F.abs(z), _sign(z)


def mad(stats: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    hit, score, direction = mad_terms(cfg)
    return _findings(stats.where(hit), keys, "rolling_mad", score, direction)


def iqr_terms(cfg: AnomalyConfig) -> Terms:
    spread, x = F.col("__q3") - F.col("__q1"), F.col("value")
    low, high = F.col("__q1") - 1.5 * spread, F.col("__q3") + 1.5 * spread
    unit = F.greatest(F.lit(TINY), spread)
    score = F.when(x < low, (low - x) / unit).otherwise((x - high) / unit)
    return (F.col("__n") >= 8) & ((x < low) | (x > high)), score, F.when(x < low, "low").otherwise("high")


def iqr(stats: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    hit, score, direction = iqr_terms(cfg)
    return _findings(stats.where(hit), keys, "rolling_iqr", score, direction)


def counts(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return indexed.groupBy(*keys).agg(F.count("*").alias("n_points"))


def seasonal(indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    """Deviation from the mean of earlier rows of the same phase, scaled by recent residuals."""
    keys, p = list(keys), cfg.season_length
    if p <= 1:
        return _findings(indexed.limit(0), keys, "seasonal_residual", F.col("value"), F.lit("change"))
    long_enough = counts(indexed, keys).where(F.col("n_points") >= 2 * p).select(*keys)
    phased = join_small(indexed, long_enough, keys, "left_semi").withColumn("__phase", F.pmod("idx", F.lit(p)))
    based = with_running(
        phased,
        [*keys, "__phase"],
        {"__sum": F.col("value"), "__cnt": F.lit(1)},
        block_rows=cfg.block_rows,
        inclusive=False,
    )
    seen = F.col("__cnt") > 0
    resid = based.withColumn("__resid", F.when(seen, F.col("value") - F.col("__sum") / F.col("__cnt")).otherwise(0.0))
    haloed = with_halo(resid, before=cfg.window, block_rows=cfg.block_rows)
    w = block_window(keys).rowsBetween(-cfg.window, -1)
    scored = own_rows(
        haloed.withColumn("__n", F.count("__resid").over(w)).withColumn("__std", F.stddev_pop("__resid").over(w))
    )
    z = F.col("__resid") / F.col("__std")
    hit = scored.where(seen & (F.col("__n") >= 8) & (F.col("__std") > TINY)).where(F.abs(z) >= cfg.threshold)
    return _findings(hit, keys, "seasonal_residual", F.abs(z), _sign(z))


def warmup_stats(indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    """Mean, deviation and last value of the first rows of each series (a bounded number of rows)."""
    keys = list(keys)
    warm = F.least(F.lit(cfg.warm), F.col("n_points") - 1)
    head = join_small(indexed.where(F.col("idx") < cfg.warm), counts(indexed, keys), keys)
    return (
        head.withColumn("warm", warm)
        .where(F.col("idx") < F.col("warm"))
        .groupBy(*keys)
        .agg(
            F.max("warm").alias("warm"),
            F.avg("value").alias("mu"),
            F.stddev_pop("value").alias("sd"),
            F.max_by("value", "idx").alias("last"),
        )
    )


def _usable(warm: DataFrame) -> DataFrame:
    return warm.where((F.col("warm") >= 3) & (F.col("sd") >= TINY))


def _cusum_limits(cfg: AnomalyConfig) -> tuple[Column, Column]:
    k = F.lit(cfg.cusum_k) if cfg.cusum_k else 0.5 * F.col("sd")
    h = F.lit(cfg.cusum_h) if cfg.cusum_h else 5.0 * F.col("sd")
    return k, h


def cusum(indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    k, h = _cusum_limits(cfg)
    start = _usable(warmup_stats(indexed, keys, cfg)).select(
        *keys, F.array(F.lit(0.0), F.lit(0.0)).alias("state"), F.array("mu", k, h).alias("params"), F.col("warm").alias("first")
    )
    folded = folds.reset_fold(
        indexed, keys, folds.cusum_step, start, ["up", "down"], F.array(F.lit(0.0), F.lit(0.0)), block=cfg.fold_block
    )
    sides = folded.select(
        *keys,
        "idx",
        "ts",
        "value",
        F.explode(
            F.array(
                F.struct(F.col("up").alias("score"), F.lit("high").alias("direction")),
                F.struct(F.col("down").alias("score"), F.lit("low").alias("direction")),
            )
        ).alias("side"),
    ).where("side.score > 0")
    return _findings(sides, keys, "cusum", F.col("side.score"), F.col("side.direction"))


def ewma_control(
    indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig, blocks: DataFrame | None = None, warm: DataFrame | None = None
) -> DataFrame:
    """``blocks`` and ``warm`` are the written packed rows and warm-up statistics, where the caller has them."""
    warm = _usable(warmup_stats(indexed, keys, cfg) if warm is None else warm)
    alpha = cfg.ewma_alpha
    start = warm.select(
        *keys, F.array("last").alias("state"), F.array("mu").alias("params"), F.col("warm").alias("first")
    )
    folded = folds.linear_fold(
        indexed, keys, folds.level_step(alpha), folds.level_matrix(alpha), start, 1, ["level"], block=cfg.fold_block, written=blocks
    )
    limit = cfg.control_l * F.col("sd") * (alpha / (2.0 - alpha)) ** 0.5
    off = F.col("level") - F.col("mu")
    hit = join_small(folded, warm, list(keys)).where(F.abs(off) > limit)
    return _findings(hit, keys, "ewma_control", F.abs(off) / limit, F.when(off > 0, "high").otherwise("low"))


def page_hinkley(indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    head = indexed.where("idx = 0")
    start = head.select(
        *keys,
        F.array(F.col("value"), F.lit(0.0)).alias("state"),
        F.array().cast("array<double>").alias("params"),
        F.lit(1).cast("bigint").alias("first"),
    )
    # a block's first value is as good a first guess of its running mean as any: alarms restart there
    guess = F.array(F.col("v")[0], F.lit(0.0))
    folded = folds.reset_fold(
        indexed, keys, folds.drift_step(cfg.ph_delta, cfg.ph_lambda), start, ["score"], guess, block=cfg.fold_block
    )
    return _findings(folded.where("score > 0"), keys, "page_hinkley", F.col("score"), F.lit("change"))


def detect(indexed: DataFrame, keys: Sequence[str], method: str, cfg: AnomalyConfig) -> DataFrame:
    robust = {"rolling_mad": mad, "rolling_iqr": iqr}
    others = {"seasonal_residual": seasonal, "cusum": cusum, "ewma_control": ewma_control, "page_hinkley": page_hinkley}
    if method == "rolling_zscore":
        return zscore(prior_window(indexed, keys, cfg), keys, cfg)
    if method in robust:
        return robust[method](robust_window(indexed, keys, cfg), keys, cfg)
    if method in others:
        return others[method](indexed, keys, cfg)
    if method == "auto":
        return detect_auto(indexed, keys, cfg)
    raise ValueError("unknown anomaly method")


AUTO_ORDER = (
    "rolling_zscore",
    "rolling_mad",
    "rolling_iqr",
    "cusum",
    "ewma_control",
    "page_hinkley",
    "seasonal_residual",
)


def _every(rows: DataFrame, keys: Sequence[str], found: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """The findings of several detectors (method, hit, score, direction) over the same rows, in one pass."""
    one = lambda method, hit, score, direction: F.when(
        hit, F.struct(score.alias("score"), F.lit(method).alias("method"), direction.alias("direction"))
    )
    hits = F.array_compact(F.array(*[one(*f) for f in found]))
    return rows.select(*keys, "idx", "ts", "value", F.explode(hits).alias("__f")).select(*keys, "idx", "ts", "value", "__f.*")


def alarms(blocks: DataFrame, keys: Sequence[str], cfg: AnomalyConfig, warm: DataFrame) -> DataFrame:
    """CUSUM and Page-Hinkley in one fold over written blocks; series without a usable warm-up have no CUSUM."""
    k, h = _cusum_limits(cfg)
    ready = _usable(warm).select(*keys, F.array("mu", k, h, F.col("warm").cast("double")).alias("params"))
    never = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(float(1 << 52)))
    opening = blocks.where("start = 0").select(*keys, F.array(F.lit(0.0), F.lit(0.0), F.col("v")[0], F.lit(0.0)).alias("state"))
    start = on_same(opening, ready, keys, "left").select(
        *keys, "state", F.coalesce("params", never).alias("params"), F.lit(0).cast("bigint").alias("first")
    )
    # sums start from zero, and a block's first value is as good a first guess of its running mean as any
    guess = F.array(F.lit(0.0), F.lit(0.0), F.col("v")[0], F.lit(0.0))
    step = folds.alarm_step(cfg.ph_delta, cfg.ph_lambda)
    folded = folds.reset_fold(blocks, keys, step, start, ["up", "down", "drift"], guess, written=blocks)
    found = (("cusum", "up", "high"), ("cusum", "down", "low"), ("page_hinkley", "drift", "change"))
    return _every(folded, keys, [(m, F.col(c) > 0, F.col(c), F.lit(d)) for m, c, d in found])


def detect_auto(indexed: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    """All detectors merged per point: highest score and its direction, sorted list of methods.

    Equal scores keep the detector that comes first in ``AUTO_ORDER``. The series is shuffled once, into blocks with the
    values before them; all detectors but the seasonal one read these.
    """
    keys = list(keys)
    blocks = materialize(window_blocks(indexed, keys, cfg))
    warm = materialize(warmup_stats(indexed, keys, cfg))
    windowed = {"rolling_zscore": zscore_terms(cfg), "rolling_mad": mad_terms(cfg), "rolling_iqr": iqr_terms(cfg)}
    found = [_every(block_statistics(blocks, keys, cfg, moments=True), keys, [(m, *terms) for m, terms in windowed.items()])]
    found += [alarms(blocks, keys, cfg, warm), ewma_control(indexed, keys, cfg, blocks, warm)]
    if cfg.season_length > 1:
        found.append(seasonal(indexed, keys, cfg))
    merged = found[0]
    for f in found[1:]:
        merged = merged.unionByName(f)
    rank = F.array_position(F.array(*map(F.lit, AUTO_ORDER)), F.col("method"))
    best = F.struct(F.col("score"), (-rank).alias("rank"))
    return merged.groupBy(*keys, "idx").agg(
        F.max_by("ts", best).alias("ts"),
        F.max_by("value", best).alias("value"),
        F.max("score").alias("score"),
        F.array_join(F.sort_array(F.collect_set("method")), ",").alias("method"),
        F.max_by("direction", best).alias("direction"),
    )


def cap(found: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` highest scores per series; ties go to the earlier point, then the method name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "idx", "method")
    return found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def summary(indexed: DataFrame, found: DataFrame, keys: Sequence[str], cfg: AnomalyConfig) -> DataFrame:
    """Points, findings and the reasons detectors were skipped, one row per series."""
    keys = list(keys)
    hits = found.groupBy(*keys).agg(F.count("*").alias("anomalies"))
    warm = warmup_stats(indexed, keys, cfg)
    p = cfg.season_length
    season = F.when(F.lit(p <= 1), F.lit("season_length<=1")).when(
        F.col("n_points") < 2 * p, F.lit("insufficient history for seasonality")
    )
    start = F.when(F.coalesce("warm", F.lit(0)) < 3, F.lit("warmup<3")).when(
        F.col("sd") < TINY, F.lit("warmup stddev ~ 0")
    )
    counted = on_same(counts(indexed, keys), hits, keys, "left")
    return (
        on_same(counted, warm.select(*keys, "warm", "sd"), keys, "left")
        .select(
            *keys,
            "n_points",
            F.coalesce("anomalies", F.lit(0)).cast("bigint").alias("anomalies"),
            F.coalesce(season, F.lit("")).alias("seasonal_note"),
            F.coalesce(start, F.lit("")).alias("warmup_note"),
        )
    )
