"""Block-wise operators against plain loops, with blocks small enough that series span many."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import anomaly, downsample, folds, forecast, positions, series

KEYS = ["series"]
CFG = anomaly.AnomalyConfig(window=12, season_length=4, block_rows=16, fold_block=16)


@pytest.fixture(scope="module")
def points(spark, walks):
    df = spark.createDataFrame(walks).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return series.positioned(series.clean_series(df, KEYS), KEYS)


def by_series(walks):
    return {k: g.sort_values("ts")["value"].to_numpy() for k, g in walks.groupby("series")}


def keyed(df, *cols):
    return {(r["series"], r["idx"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_position_is_the_rank(points, walks):
    got = keyed(points, "value")
    for name, xs in by_series(walks).items():
        assert [got[(name, i)][0] for i in range(len(xs))] == list(xs)


def test_rolling_and_running_across_blocks(points, walks):
    got = keyed(series.rolling(points, KEYS, 5, block_rows=3), "rolling_mean", "rolling_std")
    sums = keyed(positions.with_running(points, KEYS, {"total": F.col("value")}, block_rows=7), "total")
    diff = keyed(series.difference(points, KEYS, 3, block_rows=2), "diff")
    for name, xs in by_series(walks).items():
        for i in range(len(xs)):
            seg = xs[max(0, i - 4) : i + 1]
            assert got[(name, i)] == pytest.approx((seg.mean(), seg.std()), abs=1e-9)
            assert sums[(name, i)][0] == pytest.approx(xs[: i + 1].sum())
            assert diff[(name, i)][0] == pytest.approx(xs[i] - xs[i - 3] if i >= 3 else 0.0)


def loop_levels(xs, alpha):
    level, out = xs[0], [xs[0]]
    for x in xs[1:]:
        level = alpha * x + (1 - alpha) * level
        out.append(level)
    return out


@pytest.mark.parametrize("block,fan", [(5, 3), (16, 4096), (4096, 4096)])
def test_linear_fold_equals_loop(points, walks, block, fan):
    start = points.where("idx = 0").select(
        "series", F.array("value").alias("state"), F.array().cast("array<double>").alias("params"), F.lit(0).cast("bigint").alias("first")
    )
    out = folds.linear_fold(points, KEYS, folds.level_step(0.3), folds.level_matrix(0.3), start, 1, ["y"], block=block, fan=fan)
    got = keyed(out, "y")
    for name, xs in by_series(walks).items():
        for i, y in enumerate(loop_levels(xs, 0.3)):
            assert got[(name, i)][0] == pytest.approx(y, abs=1e-9)


def loop_seasonal(xs, p, h, a=0.3, b=0.1, g=0.1):
    level, trend = xs[:p].mean(), (xs[p : 2 * p].mean() - xs[:p].mean()) / p
    season, out = list(xs[:p] - level), []
    for i, x in enumerate(xs):
        before, s = level, season[i % p]
        level = a * (x - s) + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
        season[i % p] = g * (x - level) + (1 - g) * s
        out.append([level + j * trend + season[(i + j) % p] for j in range(1, h + 1)])
    return out


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_holt_winters_blocks_equal_loop(points, walks, block):
    cfg = forecast.ForecastConfig(horizon=6, season_length=4, fold_block=block)
    got = keyed(forecast.holt_winters_trace(points, KEYS, cfg), "path")
    for name, xs in by_series(walks).items():
        want = loop_seasonal(xs, 4, 6)
        for i in range(7, len(xs)):
            assert got[(name, i)][0] == pytest.approx(want[i], abs=1e-8)


def test_holt_blocks_equal_loop(points, walks):
    cfg = forecast.ForecastConfig(horizon=2, fold_block=6)
    got = keyed(forecast.holt_trace(points, KEYS, cfg), "level", "trend")
    for name, xs in by_series(walks).items():
        level, trend = xs[0], xs[1] - xs[0]
        for i in range(1, len(xs)):
            before = level
            level = 0.3 * xs[i] + 0.7 * (level + trend)
            trend = 0.1 * (level - before) + 0.9 * trend
            assert got[(name, i)] == pytest.approx((level, trend), abs=1e-9)


def loop_cusum(xs, warm):
    warm = min(warm, len(xs) - 1)
    mu, sd = xs[:warm].mean(), xs[:warm].std()
    k, h, hi, lo, out = 0.5 * sd, 5 * sd, 0.0, 0.0, set()
    for i in range(warm, len(xs)):
        hi, lo = max(0.0, hi + xs[i] - mu - k), min(0.0, lo + xs[i] - mu + k)
        if hi > h:
            out.add((i, "high"))
            hi = 0.0
        if -lo > h:
            out.add((i, "low"))
            lo = 0.0
    return out


def loop_drift(xs, delta=0.005, limit=5.0):
    mean, cum, low, out = xs[0], 0.0, 0.0, {}
    for i in range(1, len(xs)):
        mean += (xs[i] - mean) / (i + 1)
        cum += xs[i] - mean - delta
        low = min(low, cum)
        if cum - low > limit:
            out[i] = (cum - low) / limit
            mean, cum, low = xs[i], 0.0, 0.0
    return out


@pytest.mark.parametrize("block", [40, 4096])
def test_reset_folds_equal_loops(points, walks, block):
    cfg = replace(CFG, fold_block=block)
    cus = {(r["series"], r["idx"], r["direction"]) for r in anomaly.cusum(points, KEYS, cfg).collect()}
    ph = keyed(anomaly.page_hinkley(points, KEYS, cfg), "score")
    want_cus, want_ph = set(), {}
    for name, xs in by_series(walks).items():
        want_cus |= {(name, i, d) for i, d in loop_cusum(xs, cfg.warm)}
        want_ph |= {(name, i): s for i, s in loop_drift(xs).items()}
    assert cus == want_cus and cus
    assert ph.keys() == want_ph.keys() and ph
    assert all(ph[k][0] == pytest.approx(want_ph[k]) for k in ph)


def _drift_start(points):
    return points.where("idx = 0").select(
        "series", F.array(F.col("value"), F.lit(0.0)).alias("state"), F.array().cast("array<double>").alias("params"), F.lit(1).cast("bigint").alias("first")
    )


@pytest.mark.parametrize("stretch", [1, 3])
def test_stretches_of_blocks_equal_loop(points, walks, stretch):
    out = folds.reset_fold(points, KEYS, folds.drift_step(0.005, 5.0), _drift_start(points), ["score"], F.array(F.col("v")[0], F.lit(0.0)), block=40, stretch=stretch)
    got = {k: v[0] for k, v in keyed(out.where("score > 0"), "score").items()}
    want = {(name, i): s for name, xs in by_series(walks).items() for i, s in loop_drift(xs).items()}
    assert got == {k: pytest.approx(s) for k, s in want.items()} and got


def test_rounds_do_not_follow_the_number_of_blocks(points, monkeypatch):
    rounds, plain = [], folds._states
    monkeypatch.setattr(folds, "_states", lambda *a: rounds.append(1) or plain(*a))
    # without an alarm no guess of the mean comes true: a round for each of 20 blocks before
    folds.reset_fold(points, KEYS, folds.drift_step(0.005, 1e9), _drift_start(points), ["score"], F.array(F.col("v")[0], F.lit(0.0)), block=20)
    assert len(rounds) == 1


def test_ewma_control_equals_loop(points, walks):
    got = {(r["series"], r["idx"]) for r in anomaly.ewma_control(points, KEYS, CFG).collect()}
    want = set()
    for name, xs in by_series(walks).items():
        warm = min(CFG.warm, len(xs) - 1)
        mu, sd, z = xs[:warm].mean(), xs[:warm].std(), xs[warm - 1]
        for i in range(warm, len(xs)):
            z = 0.2 * xs[i] + 0.8 * z
            if abs(z - mu) > 3 * sd * math.sqrt(0.2 / 1.8):
                want.add((name, i))
    assert got == want and got


def test_order_statistics_equal_loop(points, walks):
    got = keyed(anomaly.robust_window(points, KEYS, CFG), "__n", "__med", "__mad", "__q1", "__q3")
    for name, xs in by_series(walks).items():
        for i in range(1, len(xs)):
            seg = np.sort(xs[max(0, i - 12) : i])
            n, med = len(seg), np.median(seg)
            half = n // 2
            q1, q3 = (np.median(seg[:half]), np.median(seg[n - half :])) if half else (med, med)
            assert got[(name, i)] == pytest.approx((n, med, np.median(np.abs(seg - med)), q1, q3), abs=1e-9)
    assert got[("hot", 0)][0] == 0


@pytest.mark.parametrize("block", [40, 4096])
def test_auto_equals_the_detectors_one_by_one(points, block):
    cfg = replace(CFG, fold_block=block)
    singles: dict = {}
    for place, method in enumerate(anomaly.AUTO_ORDER):
        for r in anomaly.detect(points, KEYS, method, cfg).collect():
            singles.setdefault((r["series"], r["idx"]), []).append((r["score"], -place, r["direction"], method))
    got = {(r["series"], r["idx"]): r for r in anomaly.detect_auto(points, KEYS, cfg).collect()}
    assert got.keys() == singles.keys() and got
    for key, found in singles.items():
        assert got[key]["score"] == pytest.approx(max(found)[0])
        assert got[key]["method"] == ",".join(sorted({f[3] for f in found}))
        assert got[key]["direction"] == max(found)[2]


def test_constant_series_is_silent(spark):
    flat = spark.range(40).selectExpr("'s' as series", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id) as ts", "5.0D as value")
    pts = series.positioned(flat, KEYS)
    assert anomaly.detect_auto(pts, KEYS, CFG).count() == 0
    note = anomaly.summary(pts, anomaly.cusum(pts, KEYS, CFG), KEYS, CFG).first()
    assert note["warmup_note"] == "warmup stddev ~ 0"


def loop_lttb(x, y, n):
    size, every, a, out = len(x), (len(x) - 2) / (n - 2), 0, [0]
    for i in range(n - 2):
        lo, hi = math.floor(i * every) + 1, min(math.floor((i + 1) * every) + 1, size - 1)
        nlo, nhi = math.floor((i + 1) * every) + 1, min(math.floor((i + 2) * every) + 1, size)
        cx, cy = np.mean(x[nlo:nhi]), np.mean(y[nlo:nhi])
        area = [abs((x[a] - cx) * (y[j] - y[a]) - (x[a] - x[j]) * (cy - y[a])) for j in range(lo, hi)]
        a = lo + int(np.argmax(area))
        out.append(a)
    return [*out, size - 1]


@pytest.mark.parametrize("piece", [3, 8192])
def test_lttb_equals_loop(points, walks, piece):
    rows = downsample.lttb(points, KEYS, 20, piece=piece).collect()
    for name, xs in by_series(walks).items():
        got = sorted(r["idx"] for r in rows if r["series"] == name)
        x = np.arange(len(xs)) * 3600.0 + 1704067200.0
        assert got == (loop_lttb(x, xs, 20) if len(xs) > 20 else list(range(len(xs))))


def test_resample_has_no_gaps_and_interpolates(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("a", "2024-01-01 03:20:00", 8.0)]
    df = spark.createDataFrame(rows, "series string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for method, want in (("last", [2, 2, 2, 8]), ("mean", [1.5, 1.5, 1.5, 8]), ("linear", [2, 4, 6, 8])):
        out = series.resample(df, KEYS, 3600, method, block_rows=1).orderBy("ts").collect()
        assert [r["value"] for r in out] == pytest.approx(want)
        assert [r["filled"] for r in out] == [False, True, True, False]


def test_skipped_models_rank_last(points):
    """A model without errors must not win; a short series keeps its forecast but has no error."""
    cfg = forecast.ForecastConfig(horizon=6, season_length=10, min_train=8)
    rows = {(r["series"], r["model"]): r for r in forecast.forecast_auto(points, KEYS, cfg).collect()}
    assert len(rows) == 21
    tiny = rows[("tiny", "holt_winters_add")]
    assert tiny["path"] is None and tiny["mae"] is None and tiny["skipped"] == "insufficient points for holt-winters"
    assert rows[("tiny", "naive")]["path"] is not None and rows[("tiny", "naive")]["origins"] == 0
    hot = sorted((r["rank"], r["mae"]) for (s, _), r in rows.items() if s == "hot")
    assert [m for _, m in hot] == sorted(m for _, m in hot)


def test_percentage_error_skips_zero_actuals(spark):
    df = spark.range(30).selectExpr("'s' as series", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id) as ts", "0.0D as value")
    out = forecast.backtest(series.positioned(df, KEYS), KEYS, "naive", forecast.ForecastConfig(horizon=2))
    assert {r["mape"] for r in out.collect()} == {None}
    assert forecast.score(out, KEYS).first()["mae"] == 0.0


def test_ridge_matches_least_squares(points, walks):
    cfg = forecast.ForecastConfig(horizon=3, ridge_lambda=0.5, block_rows=9)
    got = keyed(forecast.ridge_trace(points, KEYS, cfg), "path")
    xs = by_series(walks)["mid"]
    for i in (1, 10, 59):
        x, y = np.arange(i + 1.0), xs[: i + 1]
        m = np.array([[i + 1 + 0.5, x.sum()], [x.sum(), (x * x).sum() + 0.5]])
        a, b = np.linalg.solve(m, [y.sum(), (x * y).sum()])
        assert got[("mid", i)][0] == pytest.approx([a + b * (i + j) for j in (1, 2, 3)])
