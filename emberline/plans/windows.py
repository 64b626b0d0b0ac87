"""Queries T*, W*, E*, D*, L*, J5-J9 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as ad
from ..adapters import oracle
from ..operators import exhaustive as ex
from ..operators import lowcarbon as lc
from ..operators import series as se

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("select t, round(carbon, 6) as carbon from carbon_hourly")
def t_resample_hourly(spark: SparkSession, d: str) -> DataFrame:
    e = ad.events(spark, d).withColumn("t", F.expr("us div 1000000"))
    return rounded(se.resample(e, [], "t", 3600, {"value": "avg"}).withColumnRenamed("value", "carbon"))


@query("select g.t, round(c.carbon, 6) as carbon from grid g left join carbon_hourly c on c.t = g.t")
def t_regularize(spark, d):
    return rounded(se.regularize(ad.carbon_hourly(spark, d), ["zone"], "t", 3600).drop("zone"))


@query("select user_id, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id order by us desc, event_id desc) as n from ev) where n = 1")
def t_keep_last(spark, d):
    return rounded(se.keep_last(ad.events(spark, d), ["user_id"], ["us", "event_id"]).select("user_id", "event_id", "value"))


@query("""a as (select h as t, max(value) as carbon from ev where event_type = 'click' group by 1),
select_all as (select t, carbon, 0 as layer from carbon_hourly union all select t, carbon, 1 from a)
select t, round(carbon, 6) as carbon from (select *, row_number() over (partition by t order by layer desc) as n from select_all) where n = 1""")
def t_layered_union(spark, d):
    clicks = ad.events(spark, d).filter("event_type = 'click'").groupBy(F.col("h").alias("t")).agg(F.max("value").alias("carbon"))
    return rounded(se.layered([ad.carbon_hourly(spark, d).drop("zone"), clicks], ["t"]))


@query("""c as (select h as t, avg(value) as clicks from ev where event_type = 'click' group by 1), s as (select h as t, avg(value) as signups from ev where event_type = 'signup' group by 1)
select coalesce(c.t, s.t) as t, round(clicks, 6) as clicks, round(signups, 6) as signups from c full outer join s on c.t = s.t""")
def t_outer_join(spark, d):
    e = ad.events(spark, d)
    part = lambda k, n: e.filter(F.col("event_type") == k).groupBy(F.col("h").alias("t")).agg(F.avg("value").alias(n))
    return rounded(se.outer_columns([part("click", "clicks"), part("signup", "signups")], ["t"]))


@query("""select t, round((986.0::double * coal_mw + 777.0::double * fuel_oil_mw + 429.0::double * gas_mw + 494.0::double * bioenergy_mw) / nullif(nuclear_mw + wind_mw + hydro_mw + solar_mw + gas_mw + bioenergy_mw + coal_mw + fuel_oil_mw, 0), 6) as intensity,
  round(nuclear_mw + wind_mw + hydro_mw + solar_mw, 6) as low_carbon from mix""")
def t_proxy_intensity(spark, d):
    m = ad.mix_hourly(spark, d)
    return rounded(m.select("t", se.proxy_intensity().alias("intensity"), se.low_carbon(["nuclear_mw", "wind_mw", "hydro_mw", "solar_mw"]).alias("low_carbon")))


@query("""select t, case when gas_mw >= 250 then 2 when gas_mw >= 50 then 1 when gas_mw is not null then 0 end::int as regime,
  round(case when gas_mw is not null or bioenergy_mw is not null then coalesce(gas_mw, 0) + coalesce(bioenergy_mw, 0) end, 6) as dispatchable from mix""")
def t_regime_label(spark, d):
    return rounded(ad.mix_hourly(spark, d).select("t", se.regime(F.col("gas_mw"), 50, 250).alias("regime"), se.partial_sum(["gas_mw", "bioenergy_mw"]).alias("dispatchable")))


@query("select origin, horizon, model, round(prediction, 6) as prediction from predictions where horizon <= 12")
def t_unpivot(spark, d):
    p = ad.predictions(spark, d)
    wide = p.groupBy("origin", "horizon").agg(*[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in ("d2", "d7")])
    return rounded(se.tidy(wide, ["origin", "horizon"], ["d2", "d7"], most=12))


@query("""select t, round(coalesce(sum(mw) filter (direction = 'export'), 0), 6) as export, round(coalesce(sum(mw) filter (direction = 'import'), 0), 6) as import, round(sum(mw), 6) as total from schedules group by t""")
def t_pivot(spark, d):
    return rounded(se.wide_sums(ad.schedules(spark, d), ["t"], "direction", ["export", "import"], "mw"))


@query("""g as (select user_id, us // 1000000 as t, value, us // 1000000 - lag(us // 1000000) over (partition by user_id order by us // 1000000) as gap from ev)
select user_id, count(*) as rows, avg((value is null)::int::double) as missing_fraction, round(avg(coalesce((value = 0)::int::double, 0.0)), 9) as zero_fraction, coalesce(sum((gap = 0)::int), 0)::bigint as duplicate_times,
  coalesce(sum((gap > 86400)::int), 0)::bigint as gaps, round(max(gap / 86400.0::double), 9) as longest_gap, coalesce(sum((not value between 1 and 50)::int), 0)::bigint as out_of_range from g group by 1""")
def t_quality_report(spark, d):
    e = ad.events(spark, d).withColumn("t", F.expr("us div 1000000"))
    r = se.quality_report(e, ["user_id"], "t", "value", 86400, 1.0, 50.0)
    return rounded(r.fillna(0, ["duplicate_times", "gaps", "out_of_range"]), 9)


@query("""d as (select *, row_number() over (partition by us // 60000000 order by event_id desc) as n from ev)
select us // 60000000 * 60 as t, round(value, 6) as carbon_mw, null::double as absent_mw from d where n = 1""")
def t_canonical(spark, d):
    raw = ad.events(spark, d).select(F.expr("cast(timestamp_seconds(us div 60000000 * 60) as string)").alias("date_heure"), F.col("value").cast("string").alias("taux"), F.col("event_id").alias("seq"))
    return rounded(se.canonical(raw, {"taux": "carbon_mw"}, ["carbon_mw", "absent_mw"], "date_heure", "seq"))


@query("select s.origin, s.horizon, s.target, round(m.gas_mw, 6) as gas_mw, round(m.coal_mw, 6) as coal_mw from stack s left join mix m on m.t = s.target")
def t_targets_at(spark, d):
    from ..operators.features import stack

    return rounded(se.at_times(ad.mix_hourly(spark, d), stack(ad.origins(spark)), ["gas_mw", "coal_mw"]))


@query("""select t, round((986.0::double * coal_mw + 777.0::double * fuel_oil_mw + 429.0::double * gas_mw + 494.0::double * bioenergy_mw) / nullif(nuclear_mw + wind_mw + hydro_mw + solar_mw + gas_mw + bioenergy_mw + coal_mw + fuel_oil_mw, 0), 6) as carbon from mix""")
def t_proxy_target(spark, d):
    return rounded(se.with_proxy_target(ad.mix_hourly(spark, d).withColumn("carbon", F.lit(0.0)), "carbon").select("t", "carbon"))


def _series(spark, d):
    return ad.hourly(spark, d).withColumnRenamed("carbon", "v")


@query("select t, round(1 - cume_dist() over (order by carbon), 6) as score from hourly")
def w_rank_score(spark, d):
    return rounded(lc.rank_score(_series(spark, d), ["zone"]).select("t", "score"))


@query("select h.t, round(1 - (select count(*) from carbon_hourly r where r.carbon <= h.carbon)::double / (select count(*) from carbon_hourly), 6) as score from hourly h")
def w_rank_score_reference(spark, d):
    ref = ad.carbon_hourly(spark, d).withColumnRenamed("carbon", "v")
    return rounded(lc.rank_score_against(_series(spark, d), ref, ["zone"]).select("t", "score"))


@query("select t, round(1 - (carbon - min(carbon) over ()) / (max(carbon) over () - min(carbon) over ()), 6) as score from hourly")
def w_minmax(spark, d):
    return rounded(lc.min_max_score(_series(spark, d), ["zone"]).select("t", "score"))


@query("select t, (carbon <= (select quantile_cont(carbon, 0.25::double) from hourly))::int::double as score from hourly")
def w_threshold(spark, d):
    return lc.threshold_score(_series(spark, d), ["zone"]).select("t", "score")


_RUNS = """q as (select quantile_cont(carbon, 0.25::double) as lo, quantile_cont(carbon, 0.40::double) as hi from hourly),
st as (select t, carbon, carbon <= hi as stay, carbon <= lo as enter from hourly, q),
gr as (select *, sum((not stay)::int) over (order by t) as g from st),
op as (select *, max((enter and stay)::int) over (partition by g order by t) as o from gr where stay),
runs as (select g, min(t) as first, max(t) as last from op where o = 1 group by g),
mf as (select *, case when first - max(last) over (order by first rows between unbounded preceding and 1 preceding) <= 7200 then 0 else 1 end as fresh from runs),
mg as (select *, sum(fresh) over (order by first) as k from mf),
merged as (select min(first) as first, max(last) as last from mg group by k)
"""


def _spans(spark, d):
    s = _series(spark, d)
    q = s.groupBy("zone").agg(F.expr("percentile(v, 0.25)").alias("lo"), F.expr("percentile(v, 0.40)").alias("hi"))
    return lc.run_spans(lc.hysteresis_runs(s.join(q, "zone"), ["zone"], F.col("lo"), F.col("hi")), ["zone"])


@query(_RUNS + "select first, last from runs")
def w_hysteresis(spark, d):
    return _spans(spark, d).drop("zone")


@query(_RUNS + "select first, last from merged")
def w_merge_gap(spark, d):
    return lc.merge_spans(_spans(spark, d), ["zone"], 7200).drop("zone")


_SLICE = """b as (select t, carbon as v, t // 86400 as day from hourly),
m as (select *, row_number() over (partition by day order by t) as i, count(*) over (partition by day) as n,
  case when count(*) over w = 6 then round(avg(v) over w, 9) end as mean from b window w as (partition by day order by t rows between current row and 5 following)),
best as (select day, i as first from (select *, row_number() over (partition by day order by mean, i) as k from m where mean is not null) where k = 1)
"""


@query(_SLICE + "select m.day, m.t from m left join best b on b.day = m.day where case when n > 6 then i >= first and i < first + 6 else i <= 6 end")
def w_best_subwindow(spark, d):
    s = _series(spark, d).withColumn("day", F.expr("t div 86400"))
    return lc.best_slice(s, ["day"], 6).select("day", "t")


_WINDOWS = _RUNS + """, sc as (select t, carbon as v, 1 - cume_dist() over (order by carbon) as score from hourly),
blk as (select first as block, s.* from merged join sc s on s.t between first and last),
bm as (select *, row_number() over (partition by block order by t) as i, count(*) over (partition by block) as n, case when count(*) over w = 6 then round(avg(v) over w, 9) end as mean from blk window w as (partition by block order by t rows between current row and 5 following)),
bf as (select block, i as f from (select *, row_number() over (partition by block order by mean, i) as k from bm where mean is not null) where k = 1),
kept as (select bm.* from bm left join bf using (block) where case when n > 6 then i >= f and i < f + 6 else true end),
agg as (select min(t) as start, max(t) + 3600 as "end", count(*) as hours, avg(score) as score, avg(v) as mean, avg((v <= lo)::int::double) as below, stddev_pop(v) as sd from kept, q group by block),
win as (select row_number() over (order by round(score, 9) desc, start)::int as rank, start, "end", hours, score, mean, least(greatest(0.5 * below + 0.5 * (1 - least(sd / ((select stddev_pop(carbon) from hourly) + 1e-9), 1.0)), 0.0), 1.0) as confidence from agg)
"""


@query(_WINDOWS + 'select rank, start, "end", hours, round(score, 6) as score, round(mean, 6) as mean, round(confidence, 6) as confidence from win where rank <= 10')
def w_low_carbon_windows(spark, d):
    return rounded(lc.low_carbon_windows(_series(spark, d), ["zone"]).drop("zone"))


_ABSOLUTE = _WINDOWS.replace("quantile_cont(carbon, 0.25::double) as lo, quantile_cont(carbon, 0.40::double) as hi from hourly", "24.0::double as lo, 25.0::double as hi")
_ABSOLUTE = _ABSOLUTE.replace("carbon <= hi as stay, carbon <= lo as enter", "carbon <= 26.0 and (carbon <= hi or carbon <= 24.5) as stay, carbon <= 26.0 and (carbon <= lo or carbon <= 24.5) as enter")


@query(_ABSOLUTE + 'select rank, start, "end", hours, round(score, 6) as score, round(mean, 6) as mean, round(confidence, 6) as confidence from win where rank <= 10')
def w_foresight_absolute(spark, d):
    """Windows of the true series itself with thresholds in g/kWh, a floor that always counts and a ceiling that never does."""
    return rounded(lc.low_carbon_windows(_series(spark, d), ["zone"], enter_value=24.0, leave_value=25.0, floor=24.5, ceiling=26.0).drop("zone"))


@query(_WINDOWS + 'select rank, start, "end" from win where rank <= 10')
def w_reasons(spark, d):
    return lc.reasons(lc.low_carbon_windows(_series(spark, d), ["zone"])).filter(F.size("reasons") == 3).select("rank", "start", "end")


@query(_WINDOWS + """, a as (select distinct unnest(range(start, "end", 3600)) as t from win where rank <= 10), b as (select distinct unnest(range(start, "end", 3600)) as t from win where rank <= 5)
select round((select count(*) from a semi join b using (t))::double / count(*), 6) as iou, (select count(*) from a semi join b using (t)) as common, count(*) as either from (select t from a union select t from b)""")
def w_iou(spark, d):
    w = lc.low_carbon_windows(_series(spark, d), ["zone"])
    return rounded(lc.hour_iou(w, w.filter("rank <= 5")))


_CATALOG = """pre as (select model, origin, horizon, sum(prediction) over w as p, sum(actual) over w as a from predictions window w as (partition by model, origin order by horizon)),
zero as (select * from pre union all select distinct model, origin, 0, 0.0, 0.0 from predictions),
catalog as (select b.model, b.origin, b.horizon - a.horizon as duration, a.horizon + 1 as start, b.horizon as "end", (b.p - a.p) / (b.horizon - a.horizon) as predicted, (b.a - a.a) / (b.horizon - a.horizon) as actual
  from zero a join pre b on a.model = b.model and a.origin = b.origin and b.horizon > a.horizon),
"""

_DECISIONS = _CATALOG + """mins as (select *, min(predicted) over w as pmin, min(actual) over w as amin, round(predicted, 9) as rp, round(actual, 9) as ra from catalog window w as (partition by model, origin, duration)),
ranks as (select *, rank() over (partition by model, origin, duration order by rp) + (count(*) over (partition by model, origin, duration, rp) - 1) / 2.0::double as xp,
  rank() over (partition by model, origin, duration order by ra) + (count(*) over (partition by model, origin, duration, ra) - 1) / 2.0::double as xa from mins),
sel as (select model, origin, duration, min(start) as fs, min(start) filter (predicted - pmin <= 1e-9) as ss, min(start) filter (actual - amin <= 1e-9) as os, count(*) as candidates, avg(actual) as random_cost,
  count(*) filter (predicted - pmin <= 1e-9) as predicted_ties, count(*) filter (actual - amin <= 1e-9) as oracle_ties, max(predicted) - min(predicted) as pr, max(actual) - min(actual) as ar,
  avg(xp) as mp, avg(xa) as ma, avg(xp * xa) as mpa, avg(xp * xp) as mpp, avg(xa * xa) as maa from ranks group by all),
dd as (select s.*, c.predicted as selected_predicted, c.actual as selected_cost, o.actual as oracle_cost, f.actual as asap_cost,
    (select count(*) from catalog x where x.model = s.model and x.origin = s.origin and x.duration = s.duration and x.actual < c.actual - 1e-9) + 1 as rank
  from sel s join catalog c on c.model = s.model and c.origin = s.origin and c.duration = s.duration and c.start = s.ss join catalog o on o.model = s.model and o.origin = s.origin and o.duration = s.duration and o.start = s.os
  join catalog f on f.model = s.model and f.origin = s.origin and f.duration = s.duration and f.start = s.fs),
decisions as (select model, origin, duration, candidates, ss as selected_start, selected_predicted, selected_cost, os as oracle_start, oracle_cost, asap_cost, random_cost, selected_cost - oracle_cost as regret, asap_cost - selected_cost as savings,
  asap_cost - oracle_cost as opportunity, random_cost - selected_cost as random_improvement, random_cost - oracle_cost as random_regret, selected_cost - oracle_cost <= 1e-9 as top1, selected_cost <= oracle_cost + 1.0 + 1e-9 as epsilon_optimal, rank,
  case when candidates > 1 then (rank - 1)::double / (candidates - 1) else 0.0 end as rank_percentile, rank <= greatest(1, ceil(0.1 * candidates)) as top10,
  case when candidates > 1 and pr > 1e-9 and ar > 1e-9 then (mpa - mp * ma) / sqrt((mpp - mp * mp) * (maa - ma * ma)) end as spearman, predicted_ties, oracle_ties from dd)
"""


@query("""select 'not_finite' as violation, 0::bigint as n union all select 'target_mismatch', count(*) from predictions where target <> origin + horizon * 3600
union all select 'duplicate_key', count(*) from (select 1 from predictions group by model, origin, horizon having count(*) > 1)
union all select 'incomplete_horizons', count(*) from (select 1 from predictions group by model, origin having count(distinct horizon) <> 24)
union all select 'origin_support', count(*) from (select 1 from predictions group by origin having count(distinct model) <> 2)
union all select 'actual_mismatch', count(*) from (select 1 from predictions group by origin, horizon having max(actual) - min(actual) > 1e-9)""")
def e_validate(spark, d):
    return ex.query_violations(ad.predictions(spark, d))


@query(_CATALOG.rstrip().rstrip(",") + ' select model, origin, duration, start, "end", round(predicted, 9) as predicted, round(actual, 9) as actual from catalog')
def e_catalog(spark, d):
    return rounded(ex.catalog(ad.predictions(spark, d)), 9)


def _decisions(spark, d, **kw):
    return ex.decisions(ex.catalog(ad.predictions(spark, d), **kw))


@query(_DECISIONS + """select model, origin, duration, candidates, selected_start, round(selected_predicted, 9) as selected_predicted, round(selected_cost, 9) as selected_cost, oracle_start, round(oracle_cost, 9) as oracle_cost, round(asap_cost, 9) as asap_cost,
  round(random_cost, 9) as random_cost, round(regret, 9) + 0.0 as regret, round(savings, 9) + 0.0 as savings, round(opportunity, 9) + 0.0 as opportunity, round(random_improvement, 9) + 0.0 as random_improvement, round(random_regret, 9) + 0.0 as random_regret, top1, epsilon_optimal, rank,
  round(rank_percentile, 9) as rank_percentile, top10, round(spearman, 9) as spearman, predicted_ties, oracle_ties from decisions""")
def e_decisions(spark, d):
    return rounded(_decisions(spark, d), 9)


_AGG = """select {k}, count(distinct origin) as origins, round(avg(selected_cost), 6) as mean_selected, round(avg(oracle_cost), 6) as mean_oracle, round(avg(asap_cost), 6) as mean_asap, round(avg(random_cost), 6) as mean_random, round(avg(regret), 6) as mean_regret,
  round(avg(savings), 6) as mean_savings, round(avg(opportunity), 6) as mean_opportunity, round(case when sum(opportunity) > 1e-12 then 100.0::double * sum(savings) / sum(opportunity) end, 6) as oracle_potential,
  round(case when sum(opportunity) > 1e-12 then 100.0::double * sum(asap_cost - random_cost) / sum(opportunity) end, 6) as random_potential, round(avg(top1::int::double), 6) as top1_rate, round(avg(epsilon_optimal::int::double), 6) as epsilon_rate,
  round(avg(rank_percentile), 6) as mean_rank_percentile, round(avg(top10::int::double), 6) as top10_rate, round(avg(spearman), 6) as mean_spearman, count(*) filter (opportunity > 1e-12) as positive_origins from decisions group by {k}"""


@query(_DECISIONS + _AGG.format(k="model, duration"))
def e_aggregate(spark, d):
    return rounded(ex.aggregate(_decisions(spark, d)))


_SUM = """, p95 as (select {k}, quantile_cont(regret, 0.95::double) as q from {d} group by {k})
select {k}, count(*) as queries, count(distinct origin) as origins, round(avg(regret), 6) as mean_regret, round(quantile_cont(regret, 0.9::double), 6) as p90_regret, round(avg(regret) filter (regret >= q), 6) as cvar95_regret,
  round(case when sum(opportunity) > 1e-12 then 100.0::double * sum(savings) / sum(opportunity) end, 6) as oracle_potential, round(case when sum(random_regret) > 1e-12 then 100.0::double * sum(random_improvement) / sum(random_regret) end, 6) as versus_random_potential,
  round(avg(selected_start - 1.0::double), 6) as mean_delay, count(*) filter (opportunity > 1e-12) as positive_queries from {d} join p95 using ({k}) group by {k}"""


@query(_DECISIONS + _SUM.format(k="model", d="decisions"))
def e_macro(spark, d):
    return rounded(ex.summarize(_decisions(spark, d), ["model"]))


@query(_DECISIONS + ", dm as (select *, origin // 604800 as week from decisions)" + _SUM.format(k="model, week", d="dm"))
def e_monthly(spark, d):
    return rounded(ex.summarize(_decisions(spark, d).withColumn("week", F.expr("origin div 604800")), ["model", "week"]))


_DAILY = _DECISIONS + ", daily as (select origin, model, avg(regret) as r from decisions where duration < 24 group by 1, 2), deltas as (select a.origin, a.model as reference, a.r - b.r as delta from daily a join daily b on a.origin = b.origin and b.model = 'd2' and a.model <> 'd2')"


@query(_DAILY + " select reference, round(avg(delta), 6) as mean_delta, round(100.0::double * avg((delta > 1e-12)::int), 6) as better_pct, round(100.0::double * avg((abs(delta) <= 1e-12)::int), 6) as tie_pct, count(*) as origins from deltas group by 1")
def e_paired(spark, d):
    return rounded(ex.paired(_decisions(spark, d), "d2"))


_REAL = _DECISIONS[_DECISIONS.index("mins as ("):].replace("from catalog", "from candidates").replace("join catalog", "join candidates")


def _chosen(spark, d):
    return ex.decisions(ad.candidates(spark, d))


@query(_REAL + """select model, origin, duration, candidates, selected_start, round(selected_cost, 6) as selected_cost, oracle_start, round(oracle_cost, 6) as oracle_cost, round(asap_cost, 6) as asap_cost, round(random_cost, 6) as random_cost, round(regret, 6) + 0.0 as regret, top1, epsilon_optimal, rank, top10, round(spearman, 6) + 0.0 as spearman, predicted_ties, oracle_ties from decisions""")
def e_catalog_decisions(spark, d):
    """Decisions over the delivered catalogue of windows."""
    columns = ["model", "origin", "duration", "candidates", "selected_start", "selected_cost", "oracle_start", "oracle_cost", "asap_cost", "random_cost", "regret", "top1", "epsilon_optimal", "rank", "top10", "spearman", "predicted_ties", "oracle_ties"]
    return rounded(_chosen(spark, d).select(*columns))


@query(_REAL + _AGG.format(k="model, duration"))
def e_catalog_aggregate(spark, d):
    return rounded(ex.aggregate(_chosen(spark, d)))


@query(_REAL + _SUM.format(k="model", d="decisions"))
def e_catalog_macro(spark, d):
    return rounded(ex.summarize(_chosen(spark, d), ["model"]))


@query(_REAL + """, daily as (select origin, model, avg(regret) as r from decisions where duration < 24 group by 1, 2), deltas as (select a.origin, a.model as reference, a.r - b.r as delta from daily a join daily b on a.origin = b.origin and b.model = 'regime_moe' and a.model <> 'regime_moe')
select reference, round(avg(delta), 6) + 0.0 as mean_delta, round(100.0::double * avg((delta > 1e-12)::int), 6) as better_pct, round(100.0::double * avg((abs(delta) <= 1e-12)::int), 6) as tie_pct, count(*) as origins from deltas group by 1""")
def e_catalog_paired(spark, d):
    return rounded(ex.paired(_chosen(spark, d), "regime_moe"))


@query()
def e_bootstrap(spark, d):
    return rounded(ex.block_bootstrap(ex.daily_deltas(_decisions(spark, d), "d2"), ["reference"], "origin", "delta"))


@query()
def e_bootstrap_week(spark, d):
    return rounded(ex.block_bootstrap(ex.daily_deltas(_decisions(spark, d), "d2"), ["reference"], "origin", "delta", block=7))


@query()
def e_bootstrap_iid(spark, d):
    return rounded(ex.block_bootstrap(ex.daily_deltas(_decisions(spark, d), "d2"), ["reference"], "origin", "delta", block=1))


@query("select p.model, p.origin, p.horizon, round(q.prediction, 6) as direct, round(case when p.target - 86400 < p.origin then h.carbon end, 6) as d1 from predictions p join predictions q on q.model = 'd7' and q.origin = p.origin and q.horizon = p.horizon left join hourly h on h.t = p.target - 86400 where p.model = 'd2'")
def e_comparators(spark, d):
    p = ad.predictions(spark, d)
    r = ex.attach_comparators(p.filter("model = 'd2'"), p.filter("model = 'd7'"), ad.hourly(spark, d))
    return rounded(r.select("model", "origin", "horizon", "direct", "d1"))


@query("""e_p as (select model, origin, horizon, prediction, actual, round(prediction, 9) as rp, round(actual, 9) as ra from predictions),
r as (select *, rank() over (partition by model, origin order by rp) + (count(*) over (partition by model, origin, rp) - 1) / 2.0::double as xp, rank() over (partition by model, origin order by ra) + (count(*) over (partition by model, origin, ra) - 1) / 2.0::double as xa from e_p),
q as (select model, origin, arg_min(actual, (prediction, horizon)) as real, min(actual) as best, corr(xp, xa) as rho, any_value(h.carbon) as now from r left join hourly h on h.t = origin group by model, origin),
o as (select origin, min(best) as best, min(now) as now from q group by 1)
select model as strategy, round(avg(real), 6) as mean_realized, round(avg(real - best), 6) as mean_regret, round(case when avg(now) - avg(best) > 1e-9 then 100.0::double * (avg(now) - avg(real)) / (avg(now) - avg(best)) end, 6) as captured_pct, round(avg(rho), 6) as spearman,
  round(avg((real <= best + 1e-9)::int::double), 6) as top1, count(*) as n from q group by 1
union all select 'oracle', round(avg(best), 6), 0.0, 100.0, 1.0, 1.0, count(*) from o
union all select 'run_now', round(avg(now), 6), round(avg(now) - avg(best), 6), 0.0, null, null, count(now) from o""")
def e_selection(spark, d):
    return rounded(ex.hour_selection(ad.predictions(spark, d), ad.hourly(spark, d).select(F.col("t").alias("origin"), F.col("carbon").alias("now"))))


@query(_DECISIONS.replace("over w as a from predictions window", "over w as a from p23 window").replace("0.0, 0.0 from predictions", "0.0, 0.0 from p23").replace("pre as (", """p23 as (
  select 'd1' as model, s.origin, s.horizon, s.target, p.carbon as prediction, a.carbon as actual from stack s join hourly p on p.t = s.target - 86400 join hourly a on a.t = s.target where s.horizon <= 23), pre as (""", 1) + _AGG.format(k="model, duration"))
def e_common23(spark, d):
    p = ad.predictions(spark, d, {"d1": 24}, 23)
    return rounded(ex.aggregate(ex.decisions(ex.catalog(p, 23))))


_POLICY = _CATALOG + """win as (select *, row_number() over (partition by model, origin order by predicted, start) as k from catalog where duration = 3 and "end" <= 24),
pol as (select w.model, w.origin, f.predicted as np, f.actual as na, w.start as ws, w.predicted as wp, w.actual as wa, case when f.predicted > 0 then 100.0::double * (f.predicted - w.predicted) / f.predicted end as cut,
  (select min(actual) from win x where x.model = w.model and x.origin = w.origin) as foresight from win w join win f on f.model = w.model and f.origin = w.origin and f.start = 1 where w.k = 1),
policy as (select model, origin, case when ws > 1 and cut >= 5 then 'DEFER' else 'RUN_NOW' end as decision, case when ws > 1 and cut >= 5 then ws else 1 end as start, cut as reduction_pct, na as now_actual, case when ws > 1 and cut >= 5 then wa else na end as chosen_actual, foresight from pol)
"""


def _policy(spark, d):
    return ex.policy(ex.catalog(ad.predictions(spark, d), durations=[3]), 3, 24)


@query(_POLICY + "select model, origin, decision, start, round(reduction_pct, 6) as reduction_pct, round(now_actual, 6) as now_actual, round(chosen_actual, 6) as chosen_actual, round(foresight, 6) as foresight from policy")
def d_policy(spark, d):
    return rounded(_policy(spark, d))


@query(_CATALOG.rstrip().rstrip(",") + " select origin, duration, round(min(actual), 6) as foresight from catalog where model = 'd2' group by 1, 2")
def d_perfect_foresight(spark, d):
    c = ex.catalog(ad.predictions(spark, d, {"d2": 48}))
    return rounded(c.groupBy("origin", "duration").agg(F.min("actual").alias("foresight")))


@query(_POLICY + """select model, origin, round(now_actual * 2.5, 6) as now_g, round(chosen_actual * 2.5, 6) as chosen_g, round(foresight * 2.5, 6) as foresight_g, round(case when now_actual * 2.5 > 1e-12 then 100.0::double * (now_actual - chosen_actual) / now_actual end, 6) as saving_pct,
  round(case when (now_actual - foresight) * 2.5 > 1e-12 then 100.0::double * (now_actual - chosen_actual) / (now_actual - foresight) end, 6) as captured_pct, round(chosen_actual * 2.5 * 1.2, 6) as facility_g from policy""")
def d_savings(spark, d):
    return rounded(ex.savings(_policy(spark, d), 2.5, 1.2))
