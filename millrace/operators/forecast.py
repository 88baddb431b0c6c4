"""Forecast models, back-tests and model ranking over numbered series.

Every model has one *trace*: per row, what the model would predict for the next ``horizon`` rows
had the series ended there, as an array column ``path``. The forecast is the path of the last row;
the back-test compares the paths of the earlier rows with what followed. So each model reads its
series once, whatever the number of back-test origins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize, on_same
from . import folds
from .anomaly import counts
from .positions import BLOCK_ROWS, block_window, own_rows, with_halo, with_running

MODELS = ("naive", "seasonal_naive", "drift", "ses", "holt", "holt_winters_add", "ridge_time_regression")


@dataclass(frozen=True)
class ForecastConfig:
    horizon: int = 12
    season_length: int = 0
    alpha: float = 0.3
    beta: float = 0.1
    gamma: float = 0.1
    ridge_lambda: float = 0.0
    min_train: int = 8
    block_rows: int = BLOCK_ROWS
    fold_block: int = folds.BLOCK

    @property
    def origin_floor(self) -> int:
        return self.min_train if self.min_train >= 3 else 8


def _steps(cfg: ForecastConfig, at) -> Column:
    """Array of the predictions 1..horizon, each given by ``at(step)``."""
    return F.array(*[at(j) for j in range(1, cfg.horizon + 1)])


def with_future(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig) -> DataFrame:
    """Add ``ahead``: the next ``horizon`` values, NULL where the series ends before."""
    haloed = with_halo(indexed.select(*keys, "idx", "value"), after=cfg.horizon, block_rows=cfg.block_rows)
    w = block_window(keys)
    ahead = _steps(cfg, lambda j: F.lead("value", j).over(w))
    return own_rows(haloed.withColumn("ahead", ahead)).withColumn(
        "ahead", F.when(F.col("ahead")[cfg.horizon - 1].isNotNull(), F.col("ahead"))
    )


def _kept(indexed: DataFrame) -> list[str]:
    """The columns a trace passes on: the future values, where the caller added them."""
    return ["ahead"] if "ahead" in indexed.columns else []


def naive_trace(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig) -> DataFrame:
    return indexed.select(*keys, "idx", "value", *_kept(indexed), _steps(cfg, lambda j: F.col("value")).alias("path"))


def seasonal_naive_trace(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig) -> DataFrame:
    """The last season repeated; rows with less than a season of history have no path."""
    p = cfg.season_length
    haloed = with_halo(indexed, before=max(p - 1, 0), block_rows=cfg.block_rows)
    w = block_window(keys)
    path = _steps(cfg, lambda j: F.lag("value", p - 1 - ((j - 1) % p)).over(w))
    traced = own_rows(haloed.withColumn("path", path))
    return traced.where(F.col("idx") >= p - 1).select(*keys, "idx", "value", *_kept(indexed), "path")


def drift_trace(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig) -> DataFrame:
    first = indexed.where("idx = 0").select(*keys, F.col("value").alias("__y0"))
    slope = F.when(F.col("idx") == 0, 0.0).otherwise((F.col("value") - F.col("__y0")) / F.greatest("idx", F.lit(1)))
    return join_small(indexed, first, list(keys)).select(
        *keys, "idx", "value", *_kept(indexed), _steps(cfg, lambda j: F.col("value") + slope * j).alias("path")
    )


def _first_values(indexed: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` values of every series as an array, for series that have that many."""
    head = indexed.where(F.col("idx") < n).groupBy(*keys)
    rows = head.agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("__h"))
    return rows.where(F.size("__h") == n).select(*keys, F.col("__h.value").alias("h"))


def ses_trace(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig, blocks: DataFrame | None = None) -> DataFrame:
    start = _first_values(indexed, keys, 1).select(
        *keys, F.col("h").alias("state"), F.array().cast("array<double>").alias("params"), F.lit(0).cast("bigint").alias("first")
    )
    folded = folds.linear_fold(
        indexed,
        keys,
        folds.level_step(cfg.alpha),
        folds.level_matrix(cfg.alpha),
        start,
        1,
        ["level"],
        carry=_kept(indexed),
        block=cfg.fold_block,
        written=blocks,
    )
    return folded.select(*keys, "idx", "value", *_kept(indexed), "level", _steps(cfg, lambda j: F.col("level")).alias("path"))


def holt_trace(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig, blocks: DataFrame | None = None) -> DataFrame:
    h = F.col("h")
    start = _first_values(indexed, keys, 2).select(
        *keys,
        # the state before row 1: level is the first value, trend the first step
        F.array(h[0], h[1] - h[0]).alias("state"),
        F.array().cast("array<double>").alias("params"),
        F.lit(1).cast("bigint").alias("first"),
    )
    folded = folds.linear_fold(
        indexed,
        keys,
        folds.trend_step(cfg.alpha, cfg.beta),
        folds.trend_matrix(cfg.alpha, cfg.beta),
        start,
        2,
        ["level", "trend"],
        carry=_kept(indexed),
        block=cfg.fold_block,
        written=blocks,
    )
    return folded.select(
        *keys, "idx", "value", *_kept(indexed), "level", "trend", _steps(cfg, lambda j: F.col("level") + j * F.col("trend")).alias("path")
    )


def holt_winters_trace(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig, blocks: DataFrame | None = None) -> DataFrame:
    """Additive seasons; the start values come from the first two seasons, shorter series have none."""
    p = cfg.season_length
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / p
    season1, season2 = F.slice("h", 1, p), F.slice("h", p + 1, p)
    start = _first_values(indexed, keys, 2 * p).select(*keys, "h", mean(season1).alias("l0"), mean(season2).alias("l1"))
    start = start.select(
        *keys,
        F.concat(
            F.array(F.col("l0"), (F.col("l1") - F.col("l0")) / p), F.transform(season1, lambda x: x - F.col("l0"))
        ).alias("state"),
        F.array().cast("array<double>").alias("params"),
        F.lit(0).cast("bigint").alias("first"),
    )
    ahead = [f"s{j}" for j in range(min(cfg.horizon, p))]  # later steps repeat the season
    folded = folds.linear_fold(
        indexed,
        keys,
        folds.seasonal_step(cfg.alpha, cfg.beta, cfg.gamma, p, len(ahead)),
        folds.SeasonalMatrix(cfg.alpha, cfg.beta, cfg.gamma, p),
        start,
        p + 2,
        ["level", "trend", *ahead],
        carry=_kept(indexed),
        block=cfg.fold_block,
        written=blocks,
    )
    path = _steps(cfg, lambda j: F.col("level") + j * F.col("trend") + F.col(f"s{(j - 1) % p}"))
    return folded.where(F.col("idx") >= 2 * p - 1).select(
        *keys, "idx", "value", *_kept(indexed), "level", "trend", path.alias("path")
    )


def ridge_trace(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig) -> DataFrame:
    """Least squares on the row number with both coefficients penalised, from running sums.

    The sums of the row numbers have a closed form; only those that involve the values run.
    """
    lam = float(max(cfg.ridge_lambda, 0.0))
    x = F.col("idx").cast("double")
    sums = with_running(
        indexed, keys, {"__sy": F.col("value"), "__sxy": x * F.col("value")}, block_rows=cfg.block_rows
    )
    n = x + 1
    sx, sxx = x * n / 2, x * n * (2 * x + 1) / 6
    a00, a11 = n + lam, sxx + lam
    fitted = sums.withColumn("__det", a00 * a11 - sx * sx)
    a = (F.col("__sy") * a11 - F.col("__sxy") * sx) / F.col("__det")
    b = (a00 * F.col("__sxy") - sx * F.col("__sy")) / F.col("__det")
    solvable = (F.col("idx") > 0) & (F.col("__det") != 0)
    # a single row has no slope: its path is flat, as for drift
    path = _steps(cfg, lambda j: F.when(solvable, F.col("__a") + F.col("__b") * (x + j)).otherwise(F.col("value")))
    safe = lambda c: F.when(solvable, c)
    solved = fitted.withColumn("__a", safe(a)).withColumn("__b", safe(b))
    return solved.select(*keys, "idx", "value", *_kept(indexed), path.alias("path"))


TRACES = {
    "naive": naive_trace,
    "seasonal_naive": seasonal_naive_trace,
    "drift": drift_trace,
    "ses": ses_trace,
    "holt": holt_trace,
    "holt_winters_add": holt_winters_trace,
    "ridge_time_regression": ridge_trace,
}


FOLDED = ("ses", "holt", "holt_winters_add")


Model = Callable[[DataFrame, Sequence[str], ForecastConfig], DataFrame]


def trace(
    indexed: DataFrame, keys: Sequence[str], model: str | Model, cfg: ForecastConfig, blocks: DataFrame | None = None
) -> DataFrame:
    """The path that a model forecasts from every row. ``model`` is a name in ``TRACES`` or a function that adds ``path``.

    ``blocks`` are the written packed rows (with ``ahead``, where ``indexed`` has it) for the models that fold them.
    """
    if callable(model):
        return model(indexed, keys, cfg).select(*keys, "idx", "value", *_kept(indexed), "path")
    if model not in TRACES:
        raise ValueError("unknown model")
    if model in ("seasonal_naive", "holt_winters_add") and cfg.season_length <= 0:
        empty = indexed.limit(0)
        return empty.select(*keys, "idx", "value", *_kept(indexed), F.array(F.col("value")).alias("path"))
    given = {"blocks": blocks} if model in FOLDED else {}
    return TRACES[model](indexed, keys, cfg, **given).select(*keys, "idx", "value", *_kept(indexed), "path")


def forecast(indexed: DataFrame, keys: Sequence[str], model: str | Model, cfg: ForecastConfig) -> DataFrame:
    """One row per series and step ahead."""
    return last_path(indexed, trace(indexed, keys, model, cfg), keys)


def last_path(indexed: DataFrame, traced: DataFrame, keys: Sequence[str]) -> DataFrame:
    ends = counts(indexed, keys).select(*keys, (F.col("n_points") - 1).alias("idx"))
    last = join_small(traced, ends, [*keys, "idx"])
    return last.select(*keys, F.posexplode("path").alias("__p", "forecast")).select(
        *keys, (F.col("__p") + 1).cast("bigint").alias("step"), "forecast"
    )


def with_errors(traced: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Errors of every origin (a row with a full future and enough history), NULL on other rows."""
    pairs = F.arrays_zip("ahead", "path")
    origin = (F.col("idx") >= cfg.origin_floor - 1) & F.col("ahead").isNotNull()
    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda s, p: s + f(p))
    off = lambda p: p["ahead"] - p["path"]
    sized = F.filter(pairs, lambda p: F.abs(p["ahead"]) >= 1e-9)
    share = total(sized, lambda p: F.abs(off(p) / p["ahead"]))
    return traced.withColumns(
        {
            "mae": F.when(origin, total(pairs, lambda p: F.abs(off(p))) / cfg.horizon),
            "rmse": F.when(origin, F.sqrt(total(pairs, lambda p: off(p) * off(p)) / cfg.horizon)),
            "mape": F.when(origin & (F.size(sized) > 0), share / F.size(sized) * 100.0),
        }
    )


def backtest(indexed: DataFrame, keys: Sequence[str], model: str | Model, cfg: ForecastConfig) -> DataFrame:
    """Error of every origin: mean absolute, root mean square and mean percentage error.

    The percentage error skips actual values near zero and is NULL when all are.
    """
    traced = with_errors(trace(with_future(indexed, keys, cfg), keys, model, cfg), cfg)
    return traced.where(F.col("mae").isNotNull()).select(
        *keys, (F.col("idx") + 1).alias("train_rows"), "mae", "rmse", "mape"
    )


def averages():
    return (F.count("mae").alias("origins"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"))


def score(origins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average the errors over the origins."""
    return origins.groupBy(*keys).agg(*averages())


def forecast_auto(indexed: DataFrame, keys: Sequence[str], cfg: ForecastConfig) -> DataFrame:
    """All models with forecast, errors and rank; models without an error (skipped, short) rank last.

    Each model is one pass: the trace rows carry their own future, so errors and the last path come
    out of a single aggregation per model. The models that fold read the same written blocks.
    """
    keys = list(keys)
    ready = materialize(with_future(indexed, keys, cfg))
    blocks = materialize(folds.pack_blocks(ready, keys, ["ahead"], cfg.fold_block))
    parts = []
    for model in MODELS:
        traced = with_errors(trace(ready, keys, model, cfg, blocks), cfg)
        parts.append(
            traced.groupBy(*keys)
            .agg(*averages(), F.max("idx").alias("__last"), F.max_by("path", "idx").alias("path"))
            .withColumn("model", F.lit(model))
        )
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    wanted = counts(ready, keys).withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    joined = on_same(wanted, done, [*keys, "model"], "left").withColumn(
        "path", F.when(F.col("__last") == F.col("n_points") - 1, F.col("path"))
    )
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("mae"), "model")
    note = (
        F.when(F.col("path").isNotNull(), F.lit(""))
        .when(F.lit(cfg.season_length) <= 0, F.lit("season_length<=0"))
        .when(F.col("model") == "seasonal_naive", F.lit("insufficient season length"))
        .otherwise(F.lit("insufficient points for holt-winters"))
    )
    # one row per model and series reaches this window
    return joined.select(
        *keys,
        "model",
        F.row_number().over(order).cast("bigint").alias("rank"),
        "n_points",
        F.coalesce("origins", F.lit(0)).cast("bigint").alias("origins"),
        "mae",
        "rmse",
        "mape",
        "path",
        note.alias("skipped"),
    )
