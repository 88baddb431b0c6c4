"""Queries: forecast models, back-tests and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast
from .registry import query
from .suite_series import KEYS, PTS, event_points, r6

H, P = 6, 7
CFG = forecast.ForecastConfig(horizon=H, season_length=P)

T_NAIVE = "t_naive as materialized (select series, idx, j, value as pred from s, range(1, 7) r(j))"
T_SEASON = """t_seasonal_naive as materialized (select s.series, s.idx, j, b.value as pred from s, range(1, 7) r(j)
  join s b on b.series = s.series and b.idx = s.idx - 6 + ((j - 1) % 7))"""
T_DRIFT = """t_drift as materialized (select series, idx, j, case when idx = 0 then value else value + (value - y0) / idx * j end as pred
  from (select *, first_value(value) over (partition by series order by idx) as y0 from s), range(1, 7) r(j))"""
T_SES = """ses as (
  select series, idx, value as level from s where idx = 0
  union all select s.series, s.idx, 0.3 * s.value + 0.7 * e.level from ses e join s on s.series = e.series and s.idx = e.idx + 1),
t_ses as materialized (select series, idx, j, level as pred from ses, range(1, 7) r(j))"""
T_HOLT = """holt as (
  select s.series, s.idx, s.value as level, n.value - s.value as trend from s join s n on n.series = s.series and n.idx = 1 where s.idx = 0
  union all select series, idx, nl, 0.1 * (nl - level) + 0.9 * trend from (
    select s.series, s.idx, 0.3 * s.value + 0.7 * (e.level + e.trend) as nl, e.level, e.trend
    from holt e join s on s.series = e.series and s.idx = e.idx + 1)),
t_holt as materialized (select series, idx, j, level + j * trend as pred from holt, range(1, 7) r(j) where idx >= 1)"""
T_HW = """hw0 as (select series, avg(value) filter (where idx < 7) as l0, avg(value) filter (where idx >= 7) as l1,
    list(value order by idx) filter (where idx < 7) as f from s where idx < 14 group by series having count(*) = 14),
hw as (
  select series, -1::bigint as idx, l0 as level, (l1 - l0) / 7 as trend, list_transform(f, lambda x: x - l0) as sea from hw0
  union all select series, idx, nl, 0.1 * (nl - level) + 0.9 * trend,
    list_transform(sea, lambda x, i: case when i - 1 = idx % 7 then 0.1 * (value - nl) + 0.9 * x else x end) from (
    select s.series, s.idx, s.value, 0.3 * (s.value - e.sea[s.idx % 7 + 1]) + 0.7 * (e.level + e.trend) as nl, e.level, e.trend, e.sea
    from hw e join s on s.series = e.series and s.idx = e.idx + 1)),
t_holt_winters_add as materialized (select series, idx, j, level + j * trend + sea[(idx + j) % 7 + 1] as pred from hw, range(1, 7) r(j) where idx >= 13)"""
T_RIDGE = """ridge as (select series, idx, value, n, n * sxx - sx * sx as det, sy, sxy, sx, sxx from (
  select *, idx + 1.0::double as n, idx * (idx + 1.0::double) / 2 as sx, idx * (idx + 1.0::double) * (2 * idx + 1) / 6 as sxx,
    sum(value) over w as sy, sum(value * idx) over w as sxy from s window w as (partition by series order by idx))),
t_ridge_time_regression as materialized (select series, idx, j, case when idx = 0 then value else
  (sy * sxx - sxy * sx) / det + (n * sxy - sx * sy) / det * (idx + j) end as pred from ridge, range(1, 7) r(j))"""
TRACE_SQL = dict(zip(forecast.MODELS, (T_NAIVE, T_SEASON, T_DRIFT, T_SES, T_HOLT, T_HW, T_RIDGE), strict=True))
ENDS = "ends as (select series, max(idx) as idx, count(*) as n_points from s group by 1)"


def _errors(model):
    return f"""b_{model} as materialized (select t.series, t.idx, avg(abs(a.value - pred)) as mae, sqrt(avg((a.value - pred) ** 2)) as rmse,
  avg(case when abs(a.value) >= 1e-9 then abs((a.value - pred) / a.value) end) * 100 as mape
  from t_{model} t join s a on a.series = t.series and a.idx = t.idx + t.j where t.idx >= 7 group by 1, 2 having count(*) = {H}),
m_{model} as materialized (select series, count(*) as origins, avg(mae) as mae, avg(rmse) as rmse, avg(mape) as mape from b_{model} group by 1)"""


def _forecast(model):
    return lambda spark, sf: forecast.forecast(event_points(spark, sf), KEYS, model, CFG).select(
        "series", "step", r6("forecast")
    )


for _key, _model in {
    "fc_naive": "naive",
    "fc_seasonal_naive": "seasonal_naive",
    "fc_drift": "drift",
    "fc_ses": "ses",
    "fc_holt": "holt",
    "fc_holt_winters": "holt_winters_add",
    "fc_ridge_time": "ridge_time_regression",
}.items():
    query(
        _key,
        f"""with recursive {PTS}, {TRACE_SQL[_model]}, {ENDS}
        select series, j as step, round(pred, 6) as forecast from t_{_model} join ends using (series, idx)""",
    )(_forecast(_model))


@query(
    "backtest",
    f"""with recursive {PTS}, {T_HOLT}, {_errors("holt")}
    select series, idx + 1 as train_rows, round(mae, 6) as mae, round(rmse, 6) as rmse, round(mape, 6) as mape from b_holt""",
)
def _(spark, sf):
    origins = forecast.backtest(event_points(spark, sf), KEYS, "holt", CFG)
    return origins.select("series", "train_rows", r6("mae"), r6("rmse"), r6("mape"))


def _metric(metric):
    def run(spark, sf):
        origins = forecast.backtest(event_points(spark, sf), KEYS, "drift", CFG)
        return forecast.score(origins, KEYS).select("series", "origins", r6(metric))

    return run


for _m in ("mae", "rmse", "mape"):
    query(
        _m,
        f"with {PTS}, {T_DRIFT}, {_errors('drift')} select series, origins, round({_m}, 6) as {_m} from m_drift",
    )(_metric(_m))

_AUTO = ", ".join([PTS, *[TRACE_SQL[m] for m in forecast.MODELS], *[_errors(m) for m in forecast.MODELS]])
_UNION = " union all ".join(f"select '{m}' as model, * from m_{m}" for m in forecast.MODELS)


@query(
    "fc_auto",
    f"""with recursive {_AUTO} select series, model, row_number() over (partition by series order by mae, model) as rank, origins,
    round(mae, 6) as mae, round(rmse, 6) as rmse, round(mape, 6) as mape from ({_UNION})""",
)
def _(spark, sf):
    ranked = forecast.forecast_auto(event_points(spark, sf), KEYS, CFG)
    return ranked.select("series", "model", "rank", "origins", r6("mae"), r6("rmse"), r6("mape"))
