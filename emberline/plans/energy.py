"""Queries A*, J*, Q*, X* with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import adapters as ad
from ..adapters import oracle
from ..operators import accounting as ac
from ..operators import asof, experiment
from ..operators import metricsql as mq
from ..operators.regrid import finite_number
from ..operators.skew import clean_key
from .windows import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


_ANCHORS = """cs as (select pod, ts, arg_max(joules, seq) as v from kcounters group by 1, 2),
cw as (select c.*, w.start as s, w."end" as e from cs c join kpods w using (pod) where w."end" > w.start),
an as (select pod, s, e, count(*) as n, max(ts) filter (ts <= s) as b, min(ts) filter (ts > s) as a, min(ts) filter (ts >= e) as le, max(ts) filter (ts < e) as be, min((abs(ts - s), ts)) as ns, min((abs(ts - e), ts)) as ne from cw group by all),
ank as (select pod, s, e, case when s - b <= {tol} then b when a - s <= {tol} then a else ns[2] end as first, case when le - e <= {tol} then le when e - be <= {tol} then be else ne[2] end as last,
  case when s - b <= {tol} then null when a - s <= {tol} then 'no sample at or before the start' else 'start beyond tolerance' end as note_start, case when le - e <= {tol} then null when e - be <= {tol} then 'no sample at or after the end' else 'end beyond tolerance' end as note_end from an where n >= 2),
us as (select c.pod, ts, v, s, e, first, last, note_start, note_end, lag(ts) over w as pt, lag(v) over w as pv, count(*) over (partition by c.pod) as samples from cs c join ank k on k.pod = c.pod and ts between first and last and last > first window w as (partition by c.pod order by ts)),
inc as (select *, greatest(s, pt) as lo, least(e, ts) as hi, v < pv as reset, case when least(e, ts) > greatest(s, pt) then (case when v >= pv then v - pv else greatest(v, 0) end) * (least(e, ts) - greatest(s, pt)) / (ts - pt) end as j from us where pt is not null),
meas as (select w.pod, coalesce(sum(j), 0.0) as joules, count(j) as increments, coalesce(sum(reset::int), 0)::bigint as resets, coalesce(max(samples), 0)::bigint as samples, coalesce(least(1.0, max(greatest(0.0, least(e, last) - greatest(s, first)) / (e - s))), 0.0) as coverage, max(note_start) as note_start, max(note_end) as note_end
  from kpods w left join inc using (pod) group by 1)"""


#: Some counters hold impossible readings near 1e12: joules are compared to a tenth, as far as doubles carry.


@query(_ANCHORS.format(tol=90) + " select pod, round(joules, 1) as joules, increments, resets, samples, round(coverage, 6) as coverage, note_start, note_end from meas")
def a_counter_delta(spark, d):
    pods = ad.kepler_pods(spark, d)
    return rounded(ac.measure(ac.increments(ad.kepler_counters(spark, d), pods, "pod", sequence="seq"), pods, "pod").withColumn("joules", F.round("joules", 1)))


@query("""cs as (select pod, ts, arg_max(joules, seq) as v from kcounters group by 1, 2), l as (select *, lag(v) over (partition by pod order by ts) as p from cs)
select pod, round(sum(case when p is null then null when v >= p then v - p else greatest(v, 0) end), 1) as delta, coalesce(sum((v < p)::int), 0)::bigint as resets, count(*) as samples from l group by 1""")
def a_counter_simple(spark, d):
    return rounded(ac.counter_delta(ad.kepler_counters(spark, d), ["pod"], sequence="seq").fillna(0, ["resets"]).withColumn("delta", F.round("delta", 1)))


@query("""cs as (select pod, ts, arg_max(joules, seq) as v from kcounters group by 1, 2),
b as (select w.pod, max(ts) filter (ts <= start) as a, min(ts) filter (ts >= "end") as z from kpods w join cs using (pod) group by 1),
l as (select c.pod, v, lag(v) over (partition by c.pod order by ts) as p from cs c join b on b.pod = c.pod and ts between a and z)
select w.pod, round(sum(case when p is null then null when v >= p then v - p else greatest(v, 0) end), 1) as delta from kpods w left join l using (pod) group by 1""")
def a_counter_enclosing(spark, d):
    return rounded(ac.enclosing_delta(ad.kepler_counters(spark, d), ad.kepler_pods(spark, d), "pod", "seq").withColumn("delta", F.round("delta", 1)))


_CARBON = _ANCHORS.format(tol=90) + """, pts as (select t, carbon from area_points where zone = 'FR'),
ci as (select i.pod, lo as start, hi as "end", j as joules, case when (lo + hi) / 2 - p.t <= 2100 then p.carbon end as carbon from (select * from inc where j is not null) i asof left join pts p on (i.lo + i.hi) / 2 >= p.t)"""


def _increments(spark, d):
    return ac.increments(ad.kepler_counters(spark, d), ad.kepler_pods(spark, d), "pod", sequence="seq").withColumn("zone", F.lit("FR"))


@query(_CARBON + """ select pod, round(sum(joules), 1) as joules, round(sum(joules / 3.6e6 * carbon), 3) as grams, round(case when sum(joules) filter (carbon is not null) > 0 then sum(joules / 3.6e6 * carbon) / (sum(joules) filter (carbon is not null) / 3.6e6) end, 6) as intensity,
  round(case when sum(joules) > 0 then coalesce(sum(joules) filter (carbon is not null), 0) / sum(joules) else 0.0 end, 6) as carbon_coverage, sum((carbon is null)::int)::bigint as missing, count(*) as intervals from ci group by 1""")
def a_asof_carbon(spark, d):
    r = ac.account(_increments(spark, d), ad.area_points(spark, d), "pod")
    return rounded(r.withColumn("grams", F.round("grams", 3)).withColumn("joules", F.round("joules", 1)))


@query(_CARBON + ' select pod, round(start, 3) as start, round("end", 3) as "end", round(joules, 1) as joules, round(carbon, 6) as carbon from ci')
def a_carbon_intervals(spark, d):
    r = ac.carbon_intervals(_increments(spark, d).filter("joules is not null"), ad.area_points(spark, d), "pod")
    return r.select("pod", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("joules", 1).alias("joules"), F.round("carbon", 6).alias("carbon"))


_REPORT = _CARBON + """, e as (select job, min(w.start) as start, max(w."end") as "end", count(*) as pods, sum((samples = 0)::int)::bigint as pods_missing, sum(joules) as joules, sum(resets)::bigint as resets,
    sum(coverage * (w."end" - w.start)) / sum(w."end" - w.start) as coverage from meas join kpods w using (pod) group by 1),
g as (select job, sum(joules / 3.6e6 * carbon) as grams, coalesce(sum(joules) filter (carbon is not null), 0) / sum(joules) as cc, sum((carbon is null)::int)::bigint as missing from ci join kpods using (pod) group by 1),
report as (select e.*, grams, cc as carbon_coverage, missing, joules / ("end" - start) as watts, joules > 0 and pods_missing = 0 and coverage >= 0.9 and coalesce(cc, 0) >= 0.95 and grams is not null as valid from e left join g using (job))"""


def _report(spark, d):
    return ac.job_report(ad.kepler_counters(spark, d), ad.kepler_pods(spark, d), ad.area_points(spark, d), sequence="seq")


@query(_REPORT + " select job, pods, pods_missing, round(joules, 1) as joules, resets, round(coverage, 6) as coverage, round(grams, 3) as grams, round(carbon_coverage, 6) as carbon_coverage, missing, round(watts, 3) as watts, valid from report")
def a_report(spark, d):
    r = _report(spark, d)
    return r.select("job", "pods", "pods_missing", F.round("joules", 1).alias("joules"), "resets", F.round("coverage", 6).alias("coverage"), F.round("grams", 3).alias("grams"), F.round("carbon_coverage", 6).alias("carbon_coverage"), "missing", F.round("watts", 3).alias("watts"), "valid")


@query(_ANCHORS.format(tol=90).replace("from kcounters", "from kcounters where seq is not null") + """, z as (select job, m.* from meas m join kpods using (pod)), zz as (select distinct concat_ws('#', series_id, capture_id) as pod, rapl_zone, node_name from kepler_samples),
tot as (select job, sum(joules) filter (rapl_zone = 'package' and samples > 0) as total, sum(joules) filter (rapl_zone = 'core' and samples > 0) as active, sum(case when rapl_zone in ('package', 'core') then resets else 0 end)::bigint as resets from z join zz using (pod) group by 1),
cpu as (select c.capture_id as job, avg(v) as m, max(v) as x from (select capture_id, epoch_us(sample_ts) / 1e6 as ts, try_cast(trim(sample_value) as double) as v from kepler_samples where metric_name = 'node_cpu_utilization_ratio' and regexp_full_match(trim(sample_value), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) s
  join capture_runs c on c.capture_id = s.capture_id where isfinite(v) and ts between epoch_us(started_at) / 1e6 + 60 and epoch_us(ended_at) / 1e6 - 60 group by 1)
select c.capture_id as job, round(total, 1) as total_joules, round(active, 1) as active_joules, coalesce(resets, 0) as resets, round(least(m, 1.0), 6) as cpu_mean, round(least(x, 1.0), 6) as cpu_max, round(case when active > 0 then 1000.0::double / active end, 9) as job_share
from capture_runs c left join tot on tot.job = c.capture_id left join cpu on cpu.job = c.capture_id""")
def a_node_context(spark, d):
    """Every capture as a job of 1,000 J on its node: counters of the package as total, of the core as active."""
    s = ad.table(spark, d, "kepler_samples").select("node_name", "capture_id", "metric_name", "rapl_zone", (F.unix_micros("sample_ts") / 1e6).alias("ts"), finite_number(F.col("sample_value")).alias("v"), F.col("sample_id").alias("seq"))
    node = F.concat_ws("#", "node_name", "capture_id").alias("node")  # counters begin anew in every capture
    jobs = ad.table(spark, d, "capture_runs").select(F.col("capture_id").alias("job"), node, (F.unix_micros("started_at") / 1e6 + 60).alias("start"), (F.unix_micros("ended_at") / 1e6 - 60).alias("end"), F.lit(1000.0).alias("joules"))
    counters = s.filter(F.col("metric_name").endswith("_total")).select(node, F.when(F.col("rapl_zone") == "package", "total").when(F.col("rapl_zone") == "core", "active").alias("kind"), "ts", F.col("v").alias("joules"), "seq")
    cpu = s.filter("metric_name = 'node_cpu_utilization_ratio'").select(node, "ts", F.col("v").alias("ratio"))
    r = ac.node_context(jobs, counters, cpu, sequence="seq")
    return r.select("job", *[F.round(c, 1).alias(c) for c in ("total_joules", "active_joules")], "resets", F.round("cpu_mean", 6).alias("cpu_mean"), F.round("cpu_max", 6).alias("cpu_max"), F.round("job_share", 9).alias("job_share"))


@query("""en as (select us // 86400000000 as job, user_id as pod, sum(value) as joules from ev group by 1, 2), own as (select distinct us // 86400000000 as job, user_id as pod from ev where event_type <> 'error'),
jb as (select us // 86400000000 as job, sum(value) as joules, count(*) filter (event_type = 'signup' and value > 80) as restarts, avg((event_type <> 'error' or value > 1)::int::double) as up from ev group by 1), ot as (select job, sum(joules) as o, count(*) as n from en anti join own using (job, pod) where joules > 0 group by 1)
select job, round(joules, 6) as joules, round(coalesce(o, 0), 6) as other_joules, coalesce(n, 0) as other_pods, round(case when joules + coalesce(o, 0) > 0 then coalesce(o, 0) / (joules + coalesce(o, 0)) else 0 end, 6) as share, restarts, round(up, 6) as up_ratio,
  coalesce(coalesce(o, 0) / (joules + coalesce(o, 0)) <= 0.05, false) and restarts = 0 and up >= 0.99 as clean from jb left join ot using (job)""")
def a_isolation(spark, d):
    e = ad.events(spark, d).withColumn("job", F.expr("us div 86400000000")).withColumn("pod", F.col("user_id"))
    energy = e.groupBy("job", "pod").agg(F.sum("value").alias("joules"))
    node = e.groupBy("job").agg(F.sum(((F.col("event_type") == "signup") & (F.col("value") > 80)).cast("long")).alias("restarts"), F.avg(((F.col("event_type") != "error") | (F.col("value") > 1)).cast("double")).alias("up_ratio"))
    r = ac.isolation(e.groupBy("job").agg(F.sum("value").alias("joules")), e.filter("event_type <> 'error'").select("job", "pod").distinct(), energy, node)
    return rounded(r.select("job", "joules", "other_joules", "other_pods", "share", "restarts", "up_ratio", "clean"))


@query("""s as (select user_id, min(us) filter (event_type = 'signup') as st, list(us order by us) filter (event_type = 'click') as ms, max(us + 5) filter (event_type = 'view') as fin, count(*) filter (event_type = 'purchase') as ok, count(*) filter (event_type = 'error') as err from ev group by 1)
select user_id, coalesce(st, ms[1]) as start, fin as "end", case when ok > 10 then 'succeeded' when err > 5 then 'failed' end as outcome from s""")
def a_pod_lifetime(spark, d):
    g = ad.events(spark, d).groupBy("user_id").agg(
        F.struct(
            F.min(F.when(F.col("event_type") == "signup", F.col("us"))).alias("start"), F.collect_list(F.when(F.col("event_type") == "click", F.struct(F.col("us").alias("started"), F.lit(None).cast("bigint").alias("finished")))).alias("containers"),
            F.collect_list(F.when(F.col("event_type") == "view", F.struct(F.lit(None).cast("bigint").alias("started"), (F.col("us") + 5).alias("finished")))).alias("init"),
        ).alias("status"), F.sum((F.col("event_type") == "purchase").cast("int")).alias("ok"), F.sum((F.col("event_type") == "error").cast("int")).alias("err"),
    )
    kind = lambda k, cond: F.struct(F.lit(k).alias("type"), F.when(cond, "True").otherwise("False").alias("status"))
    life, out = ac.pod_lifetime(F.col("status")), ac.job_outcome(F.array(kind("Complete", F.col("ok") > 10), kind("Failed", F.col("err") > 5)), F.lit(0))
    return g.select("user_id", life["start"].alias("start"), life["end"].alias("end"), out.alias("outcome"))


@query("""select event_id, sha256(props) as sha256, strlen(props) as bytes, strlen(props) > 8 as truncated, json_type(props) = 'OBJECT' as json_object from ev""")
def a_log_capture(spark, d):
    r = ac.log_capture(ad.events(spark, d).select("event_id", "props"), "props", 8)
    return r.select("event_id", "sha256", F.col("bytes").cast("bigint").alias("bytes"), "truncated", "json_object")


@query("select user_id, sum((event_type = 'click' or event_type = 'view')::int)::bigint as kept from ev group by 1")
def a_annotations(spark, d):
    e = ad.events(spark, d).withColumn("labels", F.create_map(F.concat(F.col("event_type"), F.lit("/id")), F.col("event_id").cast("string")))
    kept = F.size(ac.allowed_annotations(F.col("labels"), ["click/", "view/"]))
    return e.groupBy("user_id").agg(F.sum(kept.cast("long")).alias("kept"))


@query("select h.event_id, case when ts - c.t <= 7200 then c.t end as matched_at, case when ts - c.t <= 7200 then round(c.carbon, 6) end as carbon from (select event_id, us / 1e6 as ts from ev) h asof left join carbon_hourly c on h.ts >= c.t where true")
def j_asof(spark, d):
    left = ad.events(spark, d).select("event_id", F.lit("FR").alias("zone"), (F.col("us") / 1e6).alias("ts"))
    return rounded(asof.asof_join(left, ad.carbon_hourly(spark, d), ["zone"], "ts", "t", ["carbon"], 7200.0, "event_id").select("event_id", "matched_at", "carbon"))


@query("""e as (select interval_id, upper(trim(area_code)) as zone, epoch_us(interval_start) / 1e6 as ts from energy_intervals)
select e.interval_id, case when ts - p.t <= 2100 then p.t end as matched_at, case when ts - p.t <= 2100 then round(p.carbon, 6) end as carbon from e asof left join area_points p on p.zone = e.zone and e.ts >= p.t""")
def j_asof_area(spark, d):
    """Every energy interval with the last intensity of its own area before it."""
    left = ad.table(spark, d, "energy_intervals").select("interval_id", clean_key("area_code").alias("zone"), (F.unix_micros("interval_start") / 1e6).alias("ts"))
    return rounded(asof.asof_join(left, ad.area_points(spark, d), ["zone"], "ts", "t", ["carbon"], 2100.0, "interval_id").select("interval_id", "matched_at", "carbon"))


_POINTS = "pts as (select 788918400 + i * 7776000 as point from range(28) r(i)),"


def _points(spark):
    return spark.range(28).select((F.lit(788918400) + F.col("id") * 7776000).alias("point"))


_ORD = ["version", "message_id", "start", "end", "mw"]


@query(_POINTS + """ known as (select p.point, m.*, row_number() over (partition by p.point, identifier order by pub desc, version desc, message_id desc, start desc, "end" desc, mw desc) as n from messages m join pts p on m.pub <= p.point)
select point, identifier, message_id, version, status from known where n = 1""")
def j_bitemporal(spark, d):
    r = asof.latest_versions(ad.messages(spark, d), _points(spark), ["identifier"], "point", "pub", _ORD)
    return r.select("point", "identifier", "message_id", "version", "status")


@query(_POINTS + ' select point, count(*) as n, round(sum(mw), 6) as mw from messages m join pts p on p.point >= m.start and p.point < m."end" group by 1')
def j_range(spark, d):
    return rounded(asof.stab(ad.messages(spark, d), _points(spark), "start", "end", "point").groupBy("point").agg(F.count("*").alias("n"), F.sum("mw").alias("mw")))


@query("select user_id, count(*) as n from ev e where not exists (select 1 from ev x where x.user_id = e.user_id and x.event_type = 'error' and x.us // 86400000000 = e.us // 86400000000) group by 1")
def j_anti(spark, d):
    e = ad.events(spark, d).withColumn("day", F.expr("us div 86400000000"))
    return e.join(e.filter("event_type = 'error'").select("user_id", "day").distinct(), ["user_id", "day"], "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("select user_id, count(*) as n from ev e where exists (select 1 from ev x where x.user_id = e.user_id and x.event_type = 'signup' and x.us // 86400000000 = e.us // 86400000000) group by 1")
def j_semi(spark, d):
    e = ad.events(spark, d).withColumn("day", F.expr("us div 86400000000"))
    return e.join(e.filter("event_type = 'signup'").select("user_id", "day").distinct(), ["user_id", "day"], "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("select origin, horizon, target, extract(hour from timezone('Europe/Paris', to_timestamp(target)))::int as hour from stack")
def j_cross(spark, d):
    s = ad.origins(spark).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(24)))).withColumn("target", F.col("origin") + F.col("horizon") * 3600)
    return s.withColumn("hour", F.hour(F.from_utc_timestamp(F.timestamp_seconds("target"), "Europe/Paris")))


@query("""a as (select h as t from ev where event_type = 'click'), b as (select h as t from ev where event_type = 'error')
select 'union' as op, count(*) as n from (select t from a union select t from b) union all select 'intersect', count(*) from (select t from a intersect select t from b) union all select 'except', count(*) from (select t from a except select t from b) union all select 'except_all', count(*) from (select t from a except all select t from b)""")
def l_set_operations(spark, d):
    e = ad.events(spark, d)
    a, b = (e.filter(F.col("event_type") == k).select(F.col("h").alias("t")) for k in ("click", "error"))
    ops = {"union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    out = None
    for name, df in ops.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select user_id, event_id, round(sum(value) over w, 6) as running, round(avg(value) over (partition by user_id order by us, event_id rows between 2 preceding and current row), 6) as moving, lag(event_id) over w as previous, lead(event_id) over w as following,
  rank() over (partition by user_id order by event_type) as type_rank, round(cume_dist() over (partition by user_id order by value), 6) as share, first_value(event_id) over w as first_id, round(sum(value) over (partition by user_id order by us // 1000000 range between 86400 preceding and current row), 6) as day_sum from ev window w as (partition by user_id order by us, event_id)""")
def l_window_frames(spark, d):
    e = ad.events(spark, d).withColumn("t", F.expr("us div 1000000"))
    by = W.partitionBy("user_id")
    w = by.orderBy("us", "event_id")
    return rounded(e.select(
        "user_id", "event_id", F.sum("value").over(w).alias("running"), F.avg("value").over(w.rowsBetween(-2, 0)).alias("moving"), F.lag("event_id").over(w).alias("previous"), F.lead("event_id").over(w).alias("following"),
        F.rank().over(by.orderBy("event_type")).alias("type_rank"), F.cume_dist().over(by.orderBy("value")).alias("share"), F.first("event_id").over(w).alias("first_id"), F.sum("value").over(by.orderBy("t").rangeBetween(-86400, 0)).alias("day_sum"),
    ))


@query("""select event_type, round(avg(value), 6) as mean, round(median(value), 6) as median, round(quantile_cont(value, 0.95::double), 6) as p95, round(stddev_pop(value), 6) as std_pop, round(stddev_samp(value), 6) as std_samp, round(corr(value, us // 3600000000), 6) as corr,
  count(distinct user_id) as users, round(sum(value) filter (user_id % 2 = 0) / sum(value), 6) as even_share from ev group by 1""")
def l_aggregates(spark, d):
    e = ad.events(spark, d)
    return rounded(e.groupBy("event_type").agg(
        F.avg("value").alias("mean"), F.median("value").alias("median"), F.expr("percentile(value, 0.95)").alias("p95"), F.stddev_pop("value").alias("std_pop"), F.stddev_samp("value").alias("std_samp"), F.corr("value", F.expr("cast(us div 3600000000 as double)")).alias("corr"),
        F.countDistinct("user_id").alias("users"), (F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))) / F.sum("value")).alias("even_share"),
    ))


def _samples(spark, d):
    e = ad.events(spark, d)
    return e.select(F.create_map(F.lit("pod"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("state"), (F.col("event_id") % 3).cast("string")).alias("labels"), F.expr("h").alias("ts"), "value", "user_id")


_END = 1706572800  # 2024-01-30 00:00 UTC


@query(f"""cs as (select pod, ts, max(joules) as v from counters where ts > {_END} - 864000 and ts <= {_END} group by 1, 2), l as (select *, lag(v) over (partition by pod order by ts) as p from cs),
inc as (select pod, sum(case when p is null then null when v >= p then v - p else greatest(v, 0) end) as i, max(ts) - min(ts) as s from l group by 1)
select pod, round(i, 6) as increase, round(case when s > 0 then i / s end, 9) as rate from inc""")
def q_increase(spark, d):
    s = ad.counter_samples(spark, d).withColumnRenamed("joules", "value")
    return mq.increase(s, ["pod"], float(_END), 864000.0).select("pod", F.round("increase", 6).alias("increase"), F.round("rate", 9).alias("rate"))


@query(f"""cs as (select pod, ts, max(joules) as v from counters where ts > {_END} - 86400 and ts <= {_END} group by 1, 2), l as (select *, lag(v) over (partition by pod order by ts) as p from cs)
select pod, round(case when max(ts) > min(ts) then sum(case when p is null then null when v >= p then v - p else greatest(v, 0) end) / (max(ts) - min(ts)) end, 9) as rate from l group by 1""")
def q_rate(spark, d):
    s = ad.counter_samples(spark, d).withColumnRenamed("joules", "value")
    return mq.increase(s, ["pod"], float(_END), 86400.0).select("pod", F.round("rate", 9).alias("rate"))


@query("""m as (select user_id, event_type, h, max(value) as v from ev group by 1, 2, 3) select event_type as kind, h as ts, round(sum(v), 6) as value from m group by 1, 2""")
def q_max_without_sum_by(spark, d):
    return rounded(mq.by(mq.without(_samples(spark, d).drop("user_id"), ["state"], "max"), ["kind"], "sum"))


@query("select user_id, count(*) as n from ev where event_type ~ '^(?:cl.*|view)$' and event_id % 3 <> 1 group by 1")
def q_selector(spark, d):
    s = mq.select(_samples(spark, d), match={"kind": "cl.*|view"}, unequal={"state": "1"})
    return s.groupBy("user_id").agg(F.count("*").alias("n"))


@query("select user_id, us // 1000000 // 900 * 900 as t, round(avg(value), 6) as avg, round(max(value), 6) as max, round(arg_max(value, (us, value)) * 900, 6) as term from ev group by 1, 2")
def q_over_time(spark, d):
    s = ad.power_samples(spark, d).select(F.col("series").alias("user_id"), "ts", F.col("watts").alias("value"))
    return rounded(mq.over_time(s, ["user_id"], 900))


@query(f"""g as (select user_id, {_END} - 259200 + i * 3600 as t from (select distinct user_id from ev), range(73) r(i)), s as (select user_id, us / 1e6 as ts, max(value) as value from ev group by 1, 2)
select g.user_id, g.t, round(s.value, 6) as value from g asof join s on s.user_id = g.user_id and g.t >= s.ts where g.t - s.ts <= 7200""")
def q_range_grid(spark, d):
    s = ad.power_samples(spark, d).select(F.col("series").alias("user_id"), "ts", F.col("watts").alias("value"))
    return rounded(mq.range_grid(s, ["user_id"], _END - 259200, _END, 3600, 7200.0))


@query("select h as t, round(sum(value) * (select max(carbon) from carbon_hourly) / 3.6e6, 9) as rate from ev group by 1")
def q_recording_rule(spark, d):
    power = ad.events(spark, d).groupBy(F.col("h").alias("t")).agg(F.sum("value").alias("watts"))
    j = mq.times_scalar(power.withColumn("rate", F.col("watts")), ad.carbon_hourly(spark, d).agg(F.max("carbon").alias("i")), "rate", "i")
    return j.select("t", F.round(F.col("rate") / 3.6e6, 9).alias("rate"))


@query("select c_custkey, n_name, c.o_orderkey from (select c_custkey, c_nationkey, o_orderkey from customer join orders on o_custkey = c_custkey) c join nation on n_nationkey = c_nationkey")
def q_group_left(spark, d):
    many = ad.table(spark, d, "customer").join(ad.table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "o_orderkey")
    return mq.group_left(many, ad.table(spark, d, "nation"), ["n_nationkey"], ["n_name"]).select("c_custkey", "n_name", "o_orderkey")


@query("select event_type, user_id, round(v, 6) as v from (select event_type, user_id, sum(value) as v, row_number() over (partition by event_type order by sum(value) desc, user_id) as n from ev group by 1, 2) where n <= 10")
def q_topk(spark, d):
    s = ad.events(spark, d).groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    return rounded(mq.topk(s, 10, "v", ["user_id"], ["event_type"]))


@query(f"select user_id, (({_END} - max(us) / 1e6) <= 5400)::int as up from ev group by 1")
def q_freshness(spark, d):
    return ad.events(spark, d).groupBy("user_id").agg(F.max("us").alias("us")).select("user_id", mq.fresh(F.lit(_END) - F.col("us") / 1e6).alias("up"))


@query("""a as (select user_id, sum(value) as clicks from ev where event_type = 'click' group by 1), b as (select user_id, sum(value) as errors from ev where event_type = 'error' group by 1)
select coalesce(a.user_id, b.user_id) as user_id, round(clicks, 6) as clicks, round(errors, 6) as errors, round(errors / clicks, 6) as ratio from a full outer join b on a.user_id = b.user_id""")
def q_join_by_field(spark, d):
    e = ad.events(spark, d)
    part = lambda k, n: e.filter(F.col("event_type") == k).groupBy("user_id").agg(F.sum("value").alias(n))
    return rounded(part("click", "clicks").join(part("error", "errors"), "user_id", "full_outer").withColumn("ratio", F.try_divide("errors", "clicks")))


def _values(spark, d):
    return ad.power_samples(spark, d).select(F.col("series").alias("user_id"), "ts", F.col("watts").alias("value"))


@query("""select user_id, count(*) as samples, round(least(1.0, count(*) / (floor((max(us) / 1e6 - min(us) / 1e6) / 43200) + 1)), 6) as coverage, round(arg_min(value, (us, value)), 6) as first, round(arg_max(value, (us, value)), 6) as last, round(min(value), 6) as least, round(max(value), 6) as most,
  round(avg(value), 6) as mean, round(quantile_cont(value, 0.5::double), 6) as median, round(quantile_cont(value, 0.95::double), 6) as p95 from ev group by 1""")
def x_series_stats(spark, d):
    return rounded(experiment.series_statistics(_values(spark, d), ["user_id"], 43200.0))


@query("""l as (select user_id, us / 1e6 as ts, value, (value + lag(value) over w) / 2 * (us / 1e6 - lag(us / 1e6) over w) as e from ev window w as (partition by user_id order by us, value))
select user_id, count(*) as samples, round(sum(e), 3) as joules, round(max(ts) - min(ts), 3) as span, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5::double), 6) as median, round(quantile_cont(value, 0.95::double), 6) as p95 from l group by 1""")
def x_trapezoid(spark, d):
    r = rounded(experiment.trapezoid(_values(spark, d), ["user_id"]))
    return r.withColumn("joules", F.round("joules", 3)).withColumn("span", F.round("span", 3))


@query("""select e.user_id as pod, count(*) as samples, round(avg(value), 6) as mean, round(max(value), 6) as most, round(arg_max(value, (us, value)), 6) as final_or_max from ev e join job_windows w on w.pod = e.user_id where us / 1e6 between w.start and w."end" group by 1""")
def x_gauge(spark, d):
    return rounded(experiment.gauge_statistics(_values(spark, d).withColumnRenamed("user_id", "pod"), ad.job_windows(spark, d), "pod"))


@query("""p as (select user_id as pod, event_id, us / 1e6 as ts, value, case when event_type = 'click' then 'package' when event_type = 'view' then null else 'core' end as zone from ev)
select pod, event_id, round(value, 6) as value, round(ts - min(ts) over (partition by pod), 3) as elapsed from p join job_windows w using (pod) where (zone = 'package' or zone is null) and ts between w.start and w."end" """)
def x_power_series(spark, d):
    e = ad.events(spark, d).select(F.col("user_id").alias("pod"), "event_id", (F.col("us") / 1e6).alias("ts"), "value", F.when(F.col("event_type") == "click", "package").when(F.col("event_type") == "view", F.lit(None)).otherwise("core").alias("zone"))
    return experiment.power_series(e, ad.job_windows(spark, d), "pod").select("pod", "event_id", F.round("value", 6).alias("value"), F.round("elapsed", 3).alias("elapsed"))


@query("""select policy, seed, count(*) as runs, round(avg(energy), 6) as energy_mean, round(stddev_samp(energy), 6) as energy_std, round(100.0::double * stddev_samp(energy) / nullif(avg(energy), 0), 6) as energy_cv_pct, round(avg(runtime), 6) as runtime_mean, round(stddev_samp(runtime), 6) as runtime_std,
  round(100.0::double * stddev_samp(runtime) / nullif(avg(runtime), 0), 6) as runtime_cv_pct from trials where valid group by 1, 2""")
def x_repeatability(spark, d):
    return rounded(experiment.repeatability(ad.trials(spark, d).filter("valid"), ["policy", "seed"], ["energy", "runtime"]))


@query("""i as (select quantile_cont(energy / runtime, 0.5::double) as idle from trials where valid and seed = 0)
select run_id, round(energy / runtime, 9) as power, round(idle, 9) as idle, round(energy / runtime - idle, 9) as above, round(100.0::double * (energy / runtime - idle) / idle, 9) as above_pct from trials, i where seed <> 0""")
def x_idle_compare(spark, d):
    t = ad.trials(spark, d).withColumn("power", F.col("energy") / F.col("runtime"))
    return rounded(experiment.idle_comparison(t.filter("seed <> 0").select("run_id", "power"), t.filter("seed = 0"), "power", "power"), 9)


@query("""a as (select policy, seed, avg(energy) as energy, avg(runtime) as runtime from trials where valid group by 1, 2), p as (select * from a where policy like '1%'), q as (select * from a where policy like '5%')
select p.seed, round(p.energy, 6) as energy_a, round(p.runtime, 6) as runtime_a, round(q.energy, 6) as energy_b, round(q.runtime, 6) as runtime_b, round(100.0::double * (q.energy - p.energy) / p.energy, 6) as energy_change_pct, round(100.0::double * (q.runtime - p.runtime) / p.runtime, 6) as runtime_change_pct from p join q using (seed)""")
def x_paired(spark, d):
    m = ad.trials(spark, d).filter("valid").groupBy("policy", "seed").agg(F.avg("energy").alias("energy"), F.avg("runtime").alias("runtime"))
    return rounded(experiment.paired_change(m.filter("policy like '1%'"), m.filter("policy like '5%'"), ["seed"], ["energy", "runtime"]))


@query("""select series_id, capture_id, count(*) as n from kepler_samples where metric_name = 'kepler_node_cpu_watts' and (rapl_zone = 'package' or rapl_zone is null) group by 1, 2""")
def x_primary(spark, d):
    s = ad.table(spark, d, "kepler_samples").groupBy("series_id", "capture_id", F.col("metric_name").alias("metric"), F.col("rapl_zone").alias("zone")).agg(F.count("*").alias("n"))
    return experiment.primary(s, "kepler_node_cpu_watts").select("series_id", "capture_id", "n")


@query("select event_type, case when event_id % 4 = 0 then null else event_id % 4 end as zone, count(*) as rows, round(sum(value), 6) as total from ev group by 1, 2")
def x_inventory(spark, d):
    e = ad.events(spark, d).withColumn("zone", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4))
    return rounded(experiment.metric_inventory(e, ["event_type", "zone"]))


@query("""select run_id, runtime > 0 and valid as usable, case when runtime <> 0 then round_even(energy * 900 / runtime, 0)::bigint end as recommended, round(energy / nullif(runtime, 0), 9) as watts, round(energy / (seed + 1), 9) as per_sample from trials""")
def x_trial_result(spark, d):
    t = ad.trials(spark, d)
    return rounded(t.select("run_id", ((F.col("runtime") > 0) & F.col("valid")).alias("usable"), experiment.recommended_samples(F.col("energy"), 900, F.col("runtime")).alias("recommended"), F.try_divide("energy", "runtime").alias("watts"), (F.col("energy") / (F.col("seed") + 1)).alias("per_sample")), 9)


@query("select user_id, count(*) / 40.0::double as coverage, (count(*) / 40.0::double >= 0.8 and max(us) > 1706400000000000) as usable from ev group by 1")
def x_idle_validity(spark, d):
    g = ad.events(spark, d).groupBy("user_id").agg((F.count("*") / 40.0).alias("coverage"), F.max("us").alias("us"))
    return g.select("user_id", "coverage", experiment.idle_validity(F.col("coverage"), F.col("us") > 1706400000000000).alias("usable"))
