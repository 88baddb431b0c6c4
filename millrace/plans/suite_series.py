"""Queries: series preparation, rolling features, detectors, downsampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, downsample, folds, series
from .registry import query, table

KEYS = ["series"]
WINDOW = 30
CFG = anomaly.AnomalyConfig(window=WINDOW, season_length=7)

PTS = """pts as materialized (select event_type as series, ts, avg(value) as value from events group by 1, 2),
s as materialized (select series, ts, value, row_number() over (partition by series order by ts) - 1 as idx from pts)"""
PRIOR = f"(partition by series order by idx rows between {WINDOW} preceding and 1 preceding)"


def event_series(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", "value")
    return series.clean_series(raw, KEYS, min_points=CFG.min_points)


def event_points(spark, sf):
    return series.positioned(event_series(spark, sf), KEYS)


def r6(name):
    return F.round(name, 6).alias(name)


@query("clean_series", "select event_type as series, ts, round(avg(value), 6) as value from events group by 1, 2")
def _(spark, sf):
    return event_series(spark, sf).select("series", "ts", r6("value"))


@query(
    "time_bucket_mean",
    """select event_type as series, time_bucket(interval 6 hours, ts) as bucket, round(avg(value), 6) as mean, count(*) as n
    from events group by 1, 2""",
)
def _(spark, sf):
    out = series.time_bucket_mean(table(spark, sf, "events").withColumnRenamed("event_type", "series"), KEYS, 6 * 3600)
    return out.select("series", "bucket", r6("mean"), "n")


@query(
    "rolling_mean",
    f"""with {PTS} select series, idx, ts, round(avg(value) over
    (partition by series order by idx rows between 6 preceding and current row), 6) as rolling_mean from s""",
)
def _(spark, sf):
    return series.rolling(event_points(spark, sf), KEYS, 7).select("series", "idx", "ts", r6("rolling_mean"))


@query(
    "rolling_std",
    f"""with {PTS} select series, idx, ts, round(stddev_pop(value) over
    (partition by series order by idx rows between 6 preceding and current row), 6) as rolling_std from s""",
)
def _(spark, sf):
    return series.rolling(event_points(spark, sf), KEYS, 7).select("series", "idx", "ts", r6("rolling_std"))


@query(
    "difference",
    f"""with {PTS} select series, idx, ts, round(coalesce(value - lag(value, 2) over
    (partition by series order by idx), 0), 6) as diff from s""",
)
def _(spark, sf):
    return series.difference(event_points(spark, sf), KEYS, 2).select("series", "idx", "ts", r6("diff"))


EWMA_SQL = """e as (
  select series, idx, value as y from s where idx = 0
  union all
  select s.series, s.idx, 0.3 * s.value + 0.7 * e.y from e join s on s.series = e.series and s.idx = e.idx + 1)"""


@query("ewma", f"with recursive {PTS}, {EWMA_SQL} select series, idx, round(y, 6) as ewma from e")
def _(spark, sf):
    points = event_points(spark, sf)
    start = points.where("idx = 0").select(
        "series",
        F.array("value").alias("state"),
        F.array().cast("array<double>").alias("params"),
        F.lit(0).cast("bigint").alias("first"),
    )
    out = folds.linear_fold(points, KEYS, folds.level_step(0.3), folds.level_matrix(0.3), start, 1, ["ewma"])
    return out.select("series", "idx", r6("ewma"))


# --- resampling: order lines per return flag, hourly events per type ---------------------------

GRID = """b as (select event_type as series, epoch(time_bucket(interval 1 hour, ts))::bigint as b, {agg} as v from events group by 1, 2),
g as (select series, unnest(generate_series(min(b), max(b), 3600)) as b from b group by series),
j as (select g.series, g.b, b.v from g left join b on b.series = g.series and b.b = g.b)"""
LAST_SQL = """select series, make_timestamp(b * 1000000) as ts,
  round(last_value(v ignore nulls) over (partition by series order by b), 6) as value, v is null as filled from j"""


def _resampled(method):
    def run(spark, sf):
        return series.resample(event_series(spark, sf), KEYS, 3600, method).select("series", "ts", r6("value"), "filled")

    return run


query("resample_last", f"with {GRID.format(agg='arg_max(value, ts)')} {LAST_SQL}")(_resampled("last"))
query("resample_mean", f"with {GRID.format(agg='avg(value)')} {LAST_SQL}")(_resampled("mean"))
query(
    "resample_linear",
    f"""with {GRID.format(agg="arg_max(value, ts)")},
    k as (select *, last_value(v ignore nulls) over w1 as y0, last_value(case when v is not null then b end ignore nulls) over w1 as b0,
        first_value(v ignore nulls) over w2 as y1, first_value(case when v is not null then b end ignore nulls) over w2 as b1
      from j window w1 as (partition by series order by b rows between unbounded preceding and current row),
        w2 as (partition by series order by b rows between current row and unbounded following))
    select series, make_timestamp(b * 1000000) as ts, v is null as filled,
      round(case when v is not null then v else y0 + (b - b0)::double / (b1 - b0) * (y1 - y0) end, 6) as value from k""",
)(_resampled("linear"))

# the carried values of the grid seen as features: what was filled, from what, and the neighbours
query(
    "carry_forward",
    f"""with {GRID.format(agg="arg_max(value, ts)")}
    select series, count(*) as grid_points, sum(case when v is null then 1 else 0 end)::bigint as carried from j group by series""",
)(
    lambda spark, sf: series.resample(event_series(spark, sf), KEYS, 3600, "last")
    .groupBy("series")
    .agg(F.count("*").alias("grid_points"), F.count_if("filled").alias("carried"))
)

# --- detectors --------------------------------------------------------------------------------

SIGN = "case when {z} > 0 then 'high' when {z} < 0 then 'low' else 'change' end"
WARM = "warm as (select series, avg(value) as mu, stddev_pop(value) as sd, arg_max(value, idx) as z0 from s where idx < 30 group by 1)"
Z_SQL = f"""d_z as (select series, idx, ts, value, abs(z) as score, 'rolling_zscore' as method, {SIGN.format(z="z")} as direction
  from (select *, (value - m) / sd as z from (select *, count(*) over w as n, avg(value) over w as m, stddev_pop(value) over w as sd
    from s window w as {PRIOR}) where n >= 3 and sd > 1e-12) where abs(z) >= 3)"""
MAD_SQL = f"""d_mad as (select series, idx, ts, value, abs(z) as score, 'rolling_mad' as method, {SIGN.format(z="z")} as direction
  from (select *, 0.6745 * (value - med) / mad as z from (select *, list_median(list_transform(l, lambda x: abs(x - med))) as mad
    from (select *, list_median(l) as med from (select *, list(value) over {PRIOR} as l from s) where len(l) >= 5)) where mad > 1e-12)
  where abs(z) >= 3)"""
IQR_SQL = f"""d_iqr as (select series, idx, ts, value,
    case when value < lo then (lo - value) / greatest(1e-12, i) else (value - hi) / greatest(1e-12, i) end as score,
    'rolling_iqr' as method, case when value < lo then 'low' else 'high' end as direction
  from (select *, q3 - q1 as i, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
    from (select *, list_median(l[1 : len(l) // 2]) as q1, list_median(l[len(l) - len(l) // 2 + 1 : len(l)]) as q3
      from (select *, list_sort(list(value) over {PRIOR}) as l from s) where len(l) >= 8)) where value < lo or value > hi)"""
SEASON_SQL = f"""d_sea as (select series, idx, ts, value, abs(z) as score, 'seasonal_residual' as method, {SIGN.format(z="z")} as direction
  from (select *, r / sd as z from (select *, count(*) over w as n, stddev_pop(r) over w as sd from (
      select *, case when base is null then 0 else value - base end as r from (
        select *, avg(value) over (partition by series, idx % 7 order by idx rows between unbounded preceding and 1 preceding) as base from s))
      window w as {PRIOR}) where base is not null and n >= 8 and sd > 1e-12) where abs(z) >= 3)"""
CUSUM_SQL = f"""{WARM}, c as (
  select series, 29::bigint as idx, 0::double as hi, 0::double as lo, 0::double as up, 0::double as down from warm where sd >= 1e-12
  union all
  select series, idx, case when nh > h then 0 else nh end, case when -nl > h then 0 else nl end,
    case when nh > h then nh / h else 0 end, case when -nl > h then -nl / h else 0 end
  from (select s.series, s.idx, greatest(0, c.hi + (s.value - w.mu - 0.5 * w.sd)) as nh,
      least(0, c.lo + (s.value - w.mu + 0.5 * w.sd)) as nl, 5 * w.sd as h
    from c join s on s.series = c.series and s.idx = c.idx + 1 join warm w on w.series = c.series)),
d_cus as (select c.series, c.idx, s.ts, s.value, c.up as score, 'cusum' as method, 'high' as direction from c join s using (series, idx) where up > 0
  union all select c.series, c.idx, s.ts, s.value, c.down, 'cusum', 'low' from c join s using (series, idx) where down > 0)"""
CONTROL_SQL = """ec as (
  select series, 29::bigint as idx, z0 as z from warm where sd >= 1e-12
  union all
  select s.series, s.idx, 0.2 * s.value + 0.8 * ec.z from ec join s on s.series = ec.series and s.idx = ec.idx + 1),
d_ewc as (select series, idx, ts, value, abs(d) / lim as score, 'ewma_control' as method, case when d > 0 then 'high' else 'low' end as direction
  from (select ec.series, ec.idx, s.ts, s.value, ec.z - w.mu as d, 3 * w.sd * sqrt(0.2 / 1.8) as lim
    from ec join s using (series, idx) join warm w using (series) where ec.idx >= 30) where abs(d) > lim)"""
PH_SQL = """ph as (
  select series, idx, value as mean, 0::double as ex, 0::double as score from s where idx = 0
  union all
  select series, idx, case when ne > 5 then value else nm end, case when ne > 5 then 0 else ne end, case when ne > 5 then ne / 5 else 0 end
  from (select series, idx, value, nm, greatest(0, ex + (value - nm - 0.005)) as ne
    from (select s.series, s.idx, s.value, ph.ex, ph.mean + (s.value - ph.mean) / (s.idx + 1) as nm
      from ph join s on s.series = ph.series and s.idx = ph.idx + 1))),
d_ph as (select ph.series, ph.idx, s.ts, s.value, ph.score, 'page_hinkley' as method, 'change' as direction
  from ph join s using (series, idx) where score > 0)"""
FOUND = "select series, idx, ts, value, round(score, 6) as score, method, direction from "
ALL_SQL = ", ".join([PTS, Z_SQL, MAD_SQL, IQR_SQL, SEASON_SQL, CUSUM_SQL, CONTROL_SQL, PH_SQL])
AUTO_SQL = f"""{ALL_SQL}, u as (select *, 1 as o from d_z union all select *, 2 from d_mad union all select *, 3 from d_iqr
    union all select *, 4 from d_cus union all select *, 5 from d_ewc union all select *, 6 from d_ph union all select *, 7 from d_sea),
  auto as (select series, idx, ts, value, max(score) as score, array_to_string(list_sort(list_distinct(list(method))), ',') as method,
    first(direction order by score desc, o) as direction from u group by series, idx, ts, value)"""


def _found(df):
    return df.select("series", "idx", "ts", "value", r6("score"), "method", "direction")


def _detector(method):
    return lambda spark, sf: _found(anomaly.detect(event_points(spark, sf), KEYS, method, CFG))


query("an_zscore", f"with {PTS}, {Z_SQL} {FOUND} d_z")(_detector("rolling_zscore"))
query("an_mad", f"with {PTS}, {MAD_SQL} {FOUND} d_mad")(_detector("rolling_mad"))
query("an_iqr", f"with {PTS}, {IQR_SQL} {FOUND} d_iqr")(_detector("rolling_iqr"))
query("an_seasonal", f"with {PTS}, {SEASON_SQL} {FOUND} d_sea")(_detector("seasonal_residual"))
query("an_cusum", f"with recursive {PTS}, {CUSUM_SQL} {FOUND} d_cus")(_detector("cusum"))
query("an_ewma_control", f"with recursive {PTS}, {WARM}, {CONTROL_SQL} {FOUND} d_ewc")(_detector("ewma_control"))
query("an_page_hinkley", f"with recursive {PTS}, {PH_SQL} {FOUND} d_ph")(_detector("page_hinkley"))
query("an_auto", f"with recursive {AUTO_SQL} {FOUND} auto")(_detector("auto"))


@query(
    "an_cap",
    f"""with {PTS}, {Z_SQL} {FOUND} (select *, row_number() over (partition by series order by score desc, idx, method) as r from d_z)
    where r <= 20""",
)
def _(spark, sf):
    return _found(anomaly.cap(anomaly.detect(event_points(spark, sf), KEYS, "rolling_zscore", CFG), KEYS, 20))


@query(
    "an_summary",
    f"""with {PTS}, {Z_SQL} select series, count(*) as n_points, (select count(*) from d_z where d_z.series = s.series) as anomalies,
    '' as seasonal_note, '' as warmup_note from s group by series""",
)
def _(spark, sf):
    points = event_points(spark, sf)
    return anomaly.summary(points, anomaly.detect(points, KEYS, "rolling_zscore", CFG), KEYS, CFG)


@query(
    "anomaly_overlay",
    f"""with {PTS}, {Z_SQL} select series, idx, ts as x, value as y, round(score, 6) as score,
    'flagged by: rolling_zscore' as reason from d_z""",
)
def _(spark, sf):
    found = anomaly.detect(event_points(spark, sf), KEYS, "rolling_zscore", CFG)
    return found.select(
        "series",
        "idx",
        F.col("ts").alias("x"),
        F.col("value").alias("y"),
        r6("score"),
        F.concat(F.lit("flagged by: "), "method").alias("reason"),
    ).orderBy("series", "x", F.desc("score"))


# --- downsampling -----------------------------------------------------------------------------

LTTB_N = 100


@query(
    "lttb",
    f"""with recursive {PTS}, n as (select series, count(*) as n from s group by 1),
    g as (select s.*, n, epoch_us(ts) / 1e6 as x, (n - 2) / {LTTB_N - 2}::double as every from s join n using (series) where n > {LTTB_N}),
    h as (select *, floor((idx - 1) / every) as k from g),
    b as (select series, idx, x, value, (case when idx = 0 then -1 when idx = n - 1 then {LTTB_N - 2} when idx < floor(k * every) + 1 then k - 1
      when idx >= floor((k + 1) * every) + 1 then k + 1 else k end)::bigint as bucket from h),
    m as (select series, bucket - 1 as bucket, avg(x) as cx, avg(value) as cy from b where bucket >= 0 group by 1, 2),
    c as (select series, bucket, idx, x, value from b where bucket = -1 union all
      select series, bucket, w.i, w.x, w.v from (
        select b.series, b.bucket, arg_max({{'i': b.idx, 'x': b.x, 'v': b.value}}, coalesce(abs((c.x - cx) * (b.value - c.value) - (c.x - b.x) * (cy - c.value)), 0)) as w
        from c join b on b.series = c.series and b.bucket = c.bucket + 1 left join m on m.series = b.series and m.bucket = b.bucket group by 1, 2))
    select series, idx, ts, value from s join n using (series) where n <= {LTTB_N} union all
    select series, idx, ts, s.value from c join s using (series, idx)""",
)
def _(spark, sf):
    return downsample.lttb(event_points(spark, sf), KEYS, LTTB_N)


@query(
    "stride_sample",
    f"""with {PTS}, n as (select series, count(*) as n from s group by 1),
    want as (select series, 0::bigint as idx from n union select series, n - 1 from n union
      select series, least(floor(k * ((n - 2)::double / 99.0)) + 1, n - 2)::bigint from n, range(1, 99) t(k))
    select series, idx, ts, value from s join want using (series, idx)""",
)
def _(spark, sf):
    return downsample.stride_sample(event_points(spark, sf), KEYS, 100)
