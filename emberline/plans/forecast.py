"""Queries F*, G*, M*, P* with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import adapters as ad
from ..adapters import oracle
from ..operators import features as fe
from ..operators import gate, models
from ..operators import series as se
from .windows import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EXPERTS = ["d2", "d7", "mix"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


def _stack(spark):
    return fe.stack(ad.origins(spark))


_PI2 = "6.283185307179586::double"


@query(f"""l as (select *, timezone('Europe/Paris', to_timestamp(target)) as lt from stack), c as (select *, extract(hour from lt)::int as hour, (extract(isodow from lt) - 1)::int as dow, extract(month from lt)::int as month, extract(doy from lt) as doy from l)
select origin, horizon, target, hour, dow, month, (dow >= 5)::int as weekend, round(sin(horizon * {_PI2} / 24), 6) + 0.0 as horizon_sin, round(cos(horizon * {_PI2} / 24), 6) + 0.0 as horizon_cos, round(sin(hour * {_PI2} / 24), 6) + 0.0 as hour_sin, round(cos(hour * {_PI2} / 24), 6) + 0.0 as hour_cos,
  round(sin(doy * {_PI2} / 365.25), 6) + 0.0 as doy_sin, round(cos(doy * {_PI2} / 365.25), 6) + 0.0 as doy_cos from c""")
def f_stack_calendar(spark, d):
    r = rounded(fe.calendar(_stack(spark)))
    return r.select(*[F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).alias(c) if c.endswith(("_sin", "_cos")) else F.col(c) for c in r.columns])


def _forecasts(spark, d):
    return ad.hourly(spark, d).select("t", F.col("carbon").alias("load_day_ahead"), (F.col("carbon") / 2).alias("plain"))


_DAYS = "timezone('Europe/Paris', to_timestamp(target))::date > timezone('Europe/Paris', to_timestamp(origin))::date"


@query(f"select origin, horizon, round(case when not ({_DAYS}) then carbon end, 6) as fc_load_day_ahead, round(carbon / 2, 6) as fc_plain from stack left join hourly on t = target")
def f_day_ahead_mask(spark, d):
    return rounded(fe.at_target(_stack(spark), _forecasts(spark, d), ["load_day_ahead", "plain"]).drop("target"))


@query("select origin, horizon, round(carbon, 6) as origin_carbon from stack left join hourly on t = origin - 3600")
def f_origin_state(spark, d):
    return rounded(fe.origin_state(_stack(spark), ad.hourly(spark, d), ["carbon"]).select("origin", "horizon", "origin_carbon"))


@query("select s.origin, s.horizon, round(case when target - 86400 < origin then a.carbon end, 6) as tgtlag24_carbon, round(case when target - 604800 < origin then b.carbon end, 6) as tgtlag168_carbon from stack s left join hourly a on a.t = target - 86400 left join hourly b on b.t = target - 604800")
def f_lags(spark, d):
    return rounded(fe.target_lags(_stack(spark), ad.hourly(spark, d), ["carbon"]).drop("target"))


@query("select s.origin, s.horizon, round(case when target - 86400 < origin then carbon end, 6) as tgtlag24_carbon from stack s left join hourly on t = target - 86400")
def f_d1(spark, d):
    return rounded(fe.target_lags(_stack(spark), ad.hourly(spark, d), ["carbon"], (24,)).drop("target"))


_MIX = "x as (select t, nuclear_mw as load_mw, case when wind_mw is not null or hydro_mw is not null then coalesce(wind_mw, 0) + coalesce(hydro_mw, 0) end as wind, solar_mw as solar from mix)"


@query(_MIX + " select t, round(wind, 6) as wind_mw, round(wind + solar, 6) as vre_mw, round(load_mw - (wind + solar), 6) as residual_mw, round(case when load_mw > 0 then (wind + solar) / load_mw end, 6) as vre_share from x")
def f_interactions(spark, d):
    m = ad.mix_hourly(spark, d).select("t", F.col("nuclear_mw").alias("load"), F.col("wind_mw").alias("onshore"), F.col("hydro_mw").alias("offshore"), F.col("solar_mw").alias("solar"))
    return rounded(fe.interactions(m, ["missing", "load"], ["onshore", "offshore"], "solar").select("t", "wind_mw", "vre_mw", "residual_mw", "vre_share"))


@query("""select t, round(nuclear_mw - gas_mw, 6) as own_residual_mw, round(case when nuclear_mw > 0 then gas_mw / nuclear_mw end, 6) as own_share, round(hydro_mw + solar_mw, 6) as hybrid_vre_mw, round(nuclear_mw - (hydro_mw + solar_mw), 6) as hybrid_residual_mw,
  round(case when nuclear_mw > 0 then (hydro_mw + solar_mw) / nuclear_mw end, 6) as hybrid_share, round(solar_mw - coal_mw, 6) as solar_gap_mw, round(wind_mw - hydro_mw, 6) as wind_gap_mw from mix""")
def f_hybrid(spark, d):
    r = fe.hybrid(ad.mix_hourly(spark, d), "nuclear_mw", "gas_mw", "solar_mw", "wind_mw", "hydro_mw", "coal_mw")
    return rounded(r.select("t", "own_residual_mw", "own_share", "hybrid_vre_mw", "hybrid_residual_mw", "hybrid_share", "solar_gap_mw", "wind_gap_mw"))


@query("""p as (select origin, horizon, carbon as x from stack left join hourly on t = target)
select origin, horizon, round(case when horizon = 1 then 0 else x - lag(x) over w end, 6) as x_ramp, round(avg(x) over o, 6) as x_mean, round(min(x) over o, 6) as x_min, round(max(x) over o, 6) as x_max, round(max(x) over o - min(x) over o, 6) as x_range,
  round(max(x) filter (horizon = 21) over o - max(x) filter (horizon = 17) over o, 6) as x_evening_ramp, round(max(x) filter (horizon between 17 and 21) over o, 6) as x_evening_max from p window w as (partition by origin order by horizon), o as (partition by origin)""")
def f_curve(spark, d):
    x = fe.at_target(_stack(spark), ad.hourly(spark, d).withColumnRenamed("carbon", "x"), ["x"], prefix="")
    return rounded(fe.curve_summary(x, "x").drop("target", "x"))


def _scale_sql(w):
    old, new = w // 2, w - w // 2
    rng = lambda n: f"over (partition by zone order by t range between {n * 3600 - 1} preceding and current row)"
    least = lambda n: max(1, -(-n // 2))
    return f"""case when count(x) {rng(w)} >= {max(2, -(-w // 2))} then avg(x) {rng(w)} end as l{w}, case when count(x) {rng(w)} >= {max(2, -(-w // 2))} then stddev_pop(x) {rng(w)} end as s{w},
  case when count(x) {rng(new)} >= {least(new)} then avg(x) {rng(new)} end as n{w}, case when count(x) {rng(old)} >= {least(old)} then avg(x) {rng(old)} end as o{w}"""


_SCALES = (3, 6, 12, 24, 48, 168)


@query(f"""zg as (select zone, unnest(range(min(t), max(t) + 1, 3600)) as t from area_hourly group by zone), g as (select zg.zone, zg.t, c.carbon as x from zg left join area_hourly c on c.zone = zg.zone and c.t = zg.t), r as (select zone, t, {', '.join(_scale_sql(w) for w in _SCALES)} from g)
select zone, t, {', '.join(f"round(l{w}, 6) as w{w}_level, round(s{w}, 6) as w{w}_volatility, round((n{w} - lag(o{w}, {w - w // 2}) over (partition by zone order by t)) / {max(w / 2.0, 1.0)}::double, 6) as w{w}_trend" for w in _SCALES)} from r""")
def f_multiscale(spark, d):
    g = se.regularize(ad.area_hourly(spark, d), ["zone"], "t", 3600).withColumnRenamed("carbon", "x")
    return rounded(fe.multiscale(g, "x", _SCALES, ["zone"]).drop("x"))


_GROUP = "case when fuel = 'NUCLEAR' then 'nuclear' when fuel = 'FOSSIL_GAS' then 'gas' when fuel = 'FOSSIL_HARD_COAL' then 'coal' when fuel like 'HYDRO_%' then 'hydro' end"
#: Monthly origins with day targets over the six years of the messages.
_LONG = "ls as (select 820454400::bigint + i * 2592000 as origin, h::int as horizon, 820454400::bigint + i * 2592000 + h * 86400 as target from range(60) r(i), range(1, 25) s(h)),"


def _long_stack(spark):
    o = spark.range(60).select((F.lit(820454400) + F.col("id") * 2592000).alias("origin"))
    return fe.stack(o, 24, 86400)


_AVAILABLE = f"""fs as (select origin, h::int as horizon, origin + h * 3600 as target from pub_days, range(0, 25) r(h)),
k as (select o.origin, m.*, rank() over (partition by o.origin, identifier order by pub desc, version desc) as n from outages m join pub_days o on m.pub <= o.origin),
hit as (select l.origin, l.horizon, k.kind, k.mw, {_GROUP} as grp from k join fs l on l.origin = k.origin and l.target >= k.start and l.target < k."end" where n = 1 and status = 'ACTIVE' and {_GROUP} is not null),
g as (select origin, horizon, sum(mw) filter (grp = 'nuclear') as nuclear, sum(mw) filter (grp = 'gas') as gas, sum(mw) filter (grp = 'coal') as coal, sum(mw) filter (grp = 'hydro') as hydro, sum(mw) as total,
  sum(mw) filter (grp = 'nuclear' and kind = 'PLANNED') as np, sum(mw) filter (grp = 'nuclear' and kind <> 'PLANNED') as nu, count(*) filter (grp = 'nuclear') as no from hit group by 1, 2)
"""
_CHANGES = ", ".join(f"round(coalesce(g.{x}, 0) - coalesce(z.{x}, 0), 6) + 0.0 as {x}_delta_mw" for x in ("nuclear", "gas", "coal", "hydro"))
_FUELS = ["nuclear", "gas", "coal", "hydro"]


@query(_AVAILABLE + f"""select fs.origin, fs.horizon, fs.target, round(coalesce(g.nuclear, 0), 6) as nuclear_mw, round(coalesce(g.gas, 0), 6) as gas_mw, round(coalesce(g.coal, 0), 6) as coal_mw, round(coalesce(g.hydro, 0), 6) as hydro_mw, round(coalesce(g.total, 0), 6) as total_mw, round(coalesce(g.np, 0), 6) as nuclear_planned_mw,
  round(coalesce(g.nu, 0), 6) as nuclear_unplanned_mw, {_CHANGES}, coalesce(g.no, 0) as nuclear_intervals
from fs left join g on g.origin = fs.origin and g.horizon = fs.horizon left join g z on z.origin = fs.origin and z.horizon = 0 where fs.horizon > 0""")
def f_availability(spark, d):
    m = ad.outages(spark, d)
    return rounded(fe.availability(m, fe.stack(ad.publication_days(m)), _FUELS))


@query(_AVAILABLE + f"select fs.origin, fs.horizon, fs.target, {_CHANGES} from fs left join g on g.origin = fs.origin and g.horizon = fs.horizon left join g z on z.origin = fs.origin and z.horizon = 0 where fs.horizon > 0")
def f_availability_delta(spark, d):
    m = ad.outages(spark, d)
    return rounded(fe.availability(m, fe.stack(ad.publication_days(m)), _FUELS, mode="delta"))


_OUT = f"""hs as (select unnest(range((min(start) + 3599) // 3600 * 3600, (max("end") + 3599) // 3600 * 3600, 3600)) as t from outages where start < "end"),
hm as (select t, epoch_us(timezone('Europe/Paris', date_trunc('day', timezone('Europe/Paris', to_timestamp(t))))) // 1000000 as midnight from hs),
sp as (select m.*, {_GROUP} as grp, n.until from outages m join (select identifier, pub, lead(pub) over (partition by identifier order by pub) as until from (select distinct identifier, pub from outages)) n on n.identifier = m.identifier and n.pub = m.pub),
og as (select t, sum(mw) filter (grp = 'nuclear') as nuclear, sum(mw) filter (grp = 'gas') as gas from sp join hm on t >= start and t < "end" and midnight > pub and (until is null or midnight <= until) where status = 'ACTIVE' group by 1),
outage as (select hs.t, round(coalesce(nuclear, 0), 6) as nuclear_mw, round(coalesce(gas, 0), 6) as gas_mw from hs left join og using (t))"""


@query(_OUT + " select * from outage")
def f_outage_by_day(spark, d):
    return rounded(fe.outage_every_hour(ad.outages(spark, d), ["nuclear", "gas"]))


@query(_OUT + """, tt as (select t, t % 1000 + nuclear_mw as n, t % 1000 + gas_mw as g from outage)
select a.t, round(a.n::double, 6) as nuclear_tightness, round(a.g::double, 6) as gas_tightness, round((a.n - b.n)::double, 6) + 0.0 as nuclear_delta_24h, round((a.g - b.g)::double, 6) + 0.0 as gas_delta_24h from tt a left join tt b on b.t = a.t - 86400""")
def f_thermal(spark, d):
    out = fe.outage_every_hour(ad.outages(spark, d), ["nuclear", "gas"])
    return rounded(fe.thermal_margin(out.select("t", (F.col("t") % 1000).cast("double").alias("residual")), out, "residual", ["nuclear", "gas"]))


@query(_LONG + """ j as (select l.origin, l.horizon, v.production_type, v.value, row_number() over (partition by l.origin, l.horizon, production_type order by updated desc, l_orderkey desc, l_linenumber desc, l_partkey desc, value desc) as n from ls l join vintages v on v.target = l.target and updated <= l.origin and updated <= l.target),
w as (select origin, horizon, max(value) filter (production_type = 'WIND_ONSHORE') as onv, max(value) filter (production_type = 'WIND_OFFSHORE') as offv, max(value) filter (production_type = 'SOLAR') as sol from j where n = 1 group by 1, 2)
select ls.origin, ls.horizon, ls.target, case when onv is not null or offv is not null then coalesce(onv, 0) + coalesce(offv, 0) end as wind_mw, sol as solar_mw, onv + offv + sol as vre_mw from ls left join w using (origin, horizon)""")
def f_vintage_d1(spark, d):
    return fe.vintaged(ad.vintages(spark, d), _long_stack(spark), ["l_orderkey", "l_linenumber", "l_partkey", "value"]).select("origin", "horizon", "target", "wind_mw", "solar_mw", "vre_mw")


@query("""f as (select *, row_number() over (partition by t, border, direction order by updated, l_orderkey, l_linenumber, l_partkey, mw) as n from schedules),
k as (select t // 3600 * 3600 as t, border, direction, avg(mw) as mw from f where n = 1 and updated < epoch_us(timezone('Europe/Paris', date_trunc('day', timezone('Europe/Paris', to_timestamp(t))))) // 1000000 group by all),
net as (select t, border, sum(case when direction = 'import' then mw else -mw end) as net from k group by 1, 2)
select t, round(coalesce(sum(net) filter (border in ('GERMANY', 'FRANCE', 'NATION_00', 'NATION_01')), 0), 6) as north, round(coalesce(sum(net) filter (border in ('UNITED KINGDOM', 'NATION_02')), 0), 6) as west, round(sum(net), 6) as total from net group by 1""")
def f_exchange(spark, d):
    groups = {"north": ["GERMANY", "FRANCE", "NATION_00", "NATION_01"], "west": ["UNITED KINGDOM", "NATION_02"]}
    return rounded(fe.exchange(ad.schedules(spark, d), ["l_orderkey", "l_linenumber", "l_partkey"], groups))


@query("""s as (select h as t, avg(value) as v, max(us) // 1000000 - 180000 + (h % 7) * 43200 as updated from ev group by 1),
k as (select t, case when updated < epoch_us(timezone('Europe/Paris', date_trunc('day', timezone('Europe/Paris', to_timestamp(t))))) // 1000000 or t < 1704499200 then v end as v from s)
select a.t, round(a.v, 6) as v, round(a.v - b.v, 6) as v_delta_24h from k a left join k b on b.t = a.t - 86400""")
def f_a71(spark, d):
    s = ad.events(spark, d).groupBy(F.col("h").alias("t")).agg(F.avg("value").alias("v"), F.max("us").alias("us"))
    s = s.select("t", "v", (F.expr("us div 1000000") - 180000 + (F.col("t") % 7) * 43200).alias("updated"))
    return rounded(fe.published_in_time(s, "v", "updated", 1704499200))


@query("select s.origin, s.horizon, s.target, round(c.carbon, 6) as carbon from stack s join carbon_hourly c on c.t = s.target")
def f_supervised(spark, d):
    return rounded(fe.supervised(_stack(spark), ad.carbon_hourly(spark, d), "carbon", ["origin"]).select("origin", "horizon", "target", "carbon"))


def _long(spark, d):
    p = ad.predictions(spark, d).withColumnsRenamed({"model": "expert", "prediction": "value"})
    mix = p.groupBy("origin", "horizon", "target", "actual").agg(F.avg("value").alias("value")).withColumn("expert", F.lit("mix"))
    # one expert lacks some values
    return p.unionByName(mix).withColumn("value", F.when((F.col("expert") == "d7") & (F.expr("origin div 86400") % 5 == 0) & (F.col("horizon") == 10), F.lit(None)).otherwise(F.col("value")))


_LX = """lx0 as (select origin, horizon, target, actual, model as expert, prediction as value from predictions union all select origin, horizon, target, any_value(actual), 'mix', avg(prediction) from predictions group by 1, 2, 3),
lx as (select origin, horizon, target, actual, expert, case when expert = 'd7' and origin // 86400 % 5 = 0 and horizon = 10 then null else value end as value, case when horizon <= 7 then 0 when horizon <= 15 then 1 when horizon <= 21 then 2 else 3 end as block from lx0),
ex as (select unnest(['d2', 'd7', 'mix']) as expert, unnest([1, 2, 3]) as pos),
hi{n} as (select o.origin as og, l.* from (select distinct origin from lx) o join lx l on l.origin < o.origin and l.target < o.origin and l.target >= o.origin - {n} * 86400),
nowb as (select origin as og, block, expert, bool_and(value is not null) as ok from lx group by all),"""
_PICK = """el as (select b.og, b.block, b.expert, s.* exclude (og, block, expert), row_number() over (partition by b.og, b.block order by round(mape, 9), pos) as k from nowb b join sc s on s.og = b.og and s.block = b.block and s.expert = b.expert join ex on ex.expert = b.expert where ok and n > 0),
ch as (select distinct b.og, b.block from nowb b), pk as (select ch.og, ch.block, coalesce(el.expert, 'd2') as expert, mape, n {extra} from ch left join el on el.og = ch.og and el.block = ch.block and k = 1)"""
_RAW = _LX.format(n=14) + "sc as (select og, block, expert, 100.0::double * avg(abs(value - actual) / actual) filter (actual > 0) as mape, count(value) filter (actual > 0) as n from hi14 group by 1, 2, 3)," + _PICK.format(extra="")


@query(_RAW + """ select l.origin, l.horizon, l.block, l.expert, round(mape, 6) as mape, n, round(coalesce(l.value, f.value), 6) as prediction, round(l.actual, 6) as actual from lx l join pk on pk.og = l.origin and pk.block = l.block and pk.expert = l.expert left join lx f on f.origin = l.origin and f.horizon = l.horizon and f.expert = 'd2'""")
def g_raw_gate(spark, d):
    return rounded(gate.raw_gate(_long(spark, d), EXPERTS, "d2").select("origin", "horizon", "block", "expert", "mape", "n", "prediction", "actual"))


_SCALE = """gs as (select og, block, expert, s, avg(abs(value * (s / 100.0::double) - actual) / actual) as l, count(*) as n from hi7, range(75, 126) r(s) where value is not null and actual > 0 group by 1, 2, 3, 4),
sc0 as (select og, block, expert, arg_min(s, (round(l, 12), s)) / 100.0::double as raw, max(n) as n from gs group by 1, 2, 3),"""


@query(_LX.format(n=7) + _SCALE.rstrip(",") + " select og as \"at\", block, expert, round(raw, 6) as raw, n from sc0")
def g_scale(spark, d):
    return rounded(gate.best_scale(gate.history(_long(spark, d), 7), ["at", "block", "expert"]))


@query(_LX.format(n=7) + _SCALE + """se as (select og, block, expert, least(greatest(1 + 0.5 * (raw - 1), 0.8), 1.2) as scale from sc0),
sc as (select h.og, h.block, h.expert, 100.0::double * avg(abs(value * scale - actual) / actual) filter (actual > 0) as mape, count(value) filter (actual > 0) as n, max(scale) as scale from hi7 h join se using (og, block, expert) group by 1, 2, 3),""" + _PICK.format(extra=", scale") + """
select l.origin, l.horizon, l.block, l.expert, round(mape, 6) as mape, n, round(scale, 6) as scale, round(coalesce(l.value * coalesce(scale, 1), f.value), 6) as prediction from lx l join pk on pk.og = l.origin and pk.block = l.block and pk.expert = l.expert left join lx f on f.origin = l.origin and f.horizon = l.horizon and f.expert = 'd2'""")
def g_calibrated(spark, d):
    return rounded(gate.calibrated_gate(_long(spark, d), EXPERTS, "d2", 7).select("origin", "horizon", "block", "expert", "mape", "n", "scale", "prediction"))


@query((_LX.format(n=14) + _SCALE + """se as (select og, block, expert, least(greatest(1 + 0.5 * (raw - 1), 0.8), 1.2) as scale from sc0),
sc as (select h.og, h.block, h.expert, 100.0::double * avg(abs(value * scale - actual) / actual) filter (actual > 0) as mape, count(value) filter (actual > 0) as n, max(scale) as scale from hi7 h join se using (og, block, expert) group by 1, 2, 3),""" + _PICK.format(extra=", scale") + """
select l.origin, l.horizon, l.block, l.expert, round(mape, 6) as mape, n, round(scale, 6) as scale, round(coalesce(l.value * coalesce(scale, 1), f.value), 6) as prediction from lx l join pk on pk.og = l.origin and pk.block = l.block and pk.expert = l.expert left join lx f on f.origin = l.origin and f.horizon = l.horizon and f.expert = 'd2'""").replace("hi7", "hi14"))
def g_calibrated_14d(spark, d):
    return rounded(gate.calibrated_gate(_long(spark, d), EXPERTS, "d2", 14).select("origin", "horizon", "block", "expert", "mape", "n", "scale", "prediction"))


_BLEND = _LX.format(n=14) + """nw as (select origin, block, horizon, max(actual) as actual, max(value) filter (expert = 'd2') as v0, max(value) filter (expert = 'd7') as v1, max(value) filter (expert = 'mix') as v2 from lx group by 1, 2, 3),
av as (select origin, block, bool_and(v0 is not null) as a0, bool_and(v1 is not null) as a1, bool_and(v2 is not null) as a2 from nw group by 1, 2),
hh as (select og as origin, block, origin as o, horizon, max(actual) as actual, max(value) filter (expert = 'd2') as v0, max(value) filter (expert = 'd7') as v1, max(value) filter (expert = 'mix') as v2 from hi14 group by 1, 2, 3, 4),
pr as (select (row_number() over ()) - 1 as k, * from (select 1.0::double as w0, 0.0::double as w1, 0.0::double as w2, 0 as z union all select 0, 1, 0, 1 union all select 0, 0, 1, 2 union all select u / 20.0, 1 - u / 20.0, 0, 100 + u from range(1, 20) r(u) union all select u / 20.0, 0, 1 - u / 20.0, 200 + u from range(1, 20) r(u) union all select 0, u / 20.0, 1 - u / 20.0, 300 + u from range(1, 20) r(u)) order by z),
ls2 as (select h.origin, h.block, pr.z, any_value(w0) as w0, any_value(w1) as w1, any_value(w2) as w2, avg(abs(w0 * coalesce(v0, 0) + w1 * coalesce(v1, 0) + w2 * coalesce(v2, 0) - actual) / actual) as l, count(*) as n from hh h join av using (origin, block), pr
  where actual > 0 and (not a0 or v0 is not null) and (not a1 or v1 is not null) and (not a2 or v2 is not null) and (a0 or w0 = 0) and (a1 or w1 = 0) and (a2 or w2 = 0) group by 1, 2, 3),
bs as (select * from (select *, row_number() over (partition by origin, block order by round(l, 11), 1e-12 * (1 - w0), z) as k from ls2) where k = 1)
"""


@query(_BLEND + """select n.origin, n.block, n.horizon, round(100.0::double * l, 6) as score, coalesce(bs.n, 0) as n, round(coalesce(w0, 1), 6) as weight_d2, round(coalesce(w1, 0), 6) as weight_d7, round(coalesce(w2, 0), 6) as weight_mix,
  round(case when coalesce(w0, 1) > 0 then coalesce(w0, 1) * v0 else 0 end + case when coalesce(w1, 0) > 0 then w1 * v1 else 0 end + case when coalesce(w2, 0) > 0 then w2 * v2 else 0 end, 6) as prediction from nw n left join bs on bs.origin = n.origin and bs.block = n.block""")
def g_blend(spark, d):
    return rounded(gate.convex_blend(_long(spark, d), EXPERTS, "d2").drop("actual"))


@query(_BLEND + "select n.block, count(*) as origins, round(avg(coalesce(w0, 1)), 6) as weight_d2, round(avg(coalesce(w1, 0)), 6) as weight_d7, round(avg(coalesce(w2, 0)), 6) as weight_mix from (select distinct origin, block from nw) n left join bs on bs.origin = n.origin and bs.block = n.block group by 1")
def g_mean_weights(spark, d):
    return rounded(gate.mean_weights(gate.convex_blend(_long(spark, d), EXPERTS, "d2"), EXPERTS))


@query("""a as (select origin, horizon, prediction from predictions where model = 'd2'), b as (select origin, horizon, prediction as d7 from predictions where model = 'd7')
select 'whole' as expert_run, a.origin, a.horizon, round(d7, 6) as d7, true as included from a join b using (origin, horizon) union all select 'unfinished', origin, horizon, null, false from a""")
def g_include_expert(spark, d):
    p = ad.predictions(spark, d)
    a, b = p.filter("model = 'd2'").select("origin", "horizon"), p.filter("model = 'd7'").select("origin", "horizon", F.col("prediction").alias("d7"))
    run = lambda name, x: gate.include_expert(a, x, ["origin", "horizon"], ["d7"]).withColumn("expert_run", F.lit(name))
    return rounded(run("whole", b).unionByName(run("unfinished", b.filter("horizon < 24"))))


@query(_RAW + " select block, expert, count(*) as n from pk group by 1, 2")
def g_selection_counts(spark, d):
    return gate.selection_counts(gate.raw_gate(_long(spark, d), EXPERTS, "d2"))


@query("a as (select origin, horizon from predictions where model = 'd2'), b as (select origin, horizon from predictions where model = 'd7' and horizon < 24) select (select count(*) from (select * from a except all select * from b)) as missing, (select count(*) from (select * from b except all select * from a)) as extra")
def g_key_alignment(spark, d):
    p = ad.predictions(spark, d)
    return gate.key_differences(p.filter("model = 'd2'"), p.filter("model = 'd7' and horizon < 24"), ["origin", "horizon"])


@query("""v as (select t, gas_mw as base, nuclear_mw + 1 as total, bioenergy_mw as b1, coal_mw as bp, fuel_oil_mw as o1, wind_mw as op from mix_filled)
select t, round(greatest(base + 494.0::double * (coalesce(b1, bp) - bp) / total, 0), 6) as with_bio, round(greatest(base + 494.0::double * (coalesce(b1, bp) - bp) / total + 777.0::double * (coalesce(o1, op) - op) / total, 0), 6) as with_bio_oil from v""")
def g_physical_variants(spark, d):
    m = ad.mix_hourly(spark, d, True).withColumn("total", F.col("nuclear_mw") + 1)
    return rounded(gate.physical_variants(m, "gas_mw", "total", ("bioenergy_mw", "coal_mw"), ("fuel_oil_mw", "wind_mw")).select("t", "with_bio", "with_bio_oil"))


@query("""select t, round((429.0::double * gas_mw + 986.0::double * coal_mw + 777.0::double * fuel_oil_mw + 494.0::double * bioenergy_mw) / greatest(nuclear_mw, gas_mw + coal_mw + fuel_oil_mw + bioenergy_mw, 1), 6) as prediction, round(greatest(nuclear_mw, gas_mw + coal_mw + fuel_oil_mw + bioenergy_mw, 1), 6) as denominator from mix_filled""")
def m_physical_head(spark, d):
    c = F.col
    p, den = models.physical_head(c("gas_mw"), c("coal_mw"), c("fuel_oil_mw"), c("bioenergy_mw"), c("nuclear_mw"))
    return rounded(ad.mix_hourly(spark, d, True).select("t", p.alias("prediction"), den.alias("denominator")))


_SH = "s as (select t, (nuclear_mw + 1) / (nuclear_mw + wind_mw + hydro_mw + 3) as a, (wind_mw + 1) / (nuclear_mw + wind_mw + hydro_mw + 3) as b, (hydro_mw + 1) / (nuclear_mw + wind_mw + hydro_mw + 3) as c, gas_mw as x, coal_mw as y, solar_mw as z from mix_filled)"


@query(_SH + f""" select t, {', '.join(f'round((a ** {k} * x + b ** {k} * y + c ** {k} * z) / greatest(a ** {k} + b ** {k} + c ** {k}, 1e-12), 6) as gas_alpha{k}' for k in (2, 3, 5))},
  round(case when a >= b and a >= c then x when b >= c then y else z end, 6) as gas_hard, round(greatest(50 + 429.0::double * (case when a >= b and a >= c then x when b >= c then y else z end - x) / 10000, 0), 6) as variant_hard from s""")
def m_sharpen(spark, d):
    m = ad.mix_hourly(spark, d, True)
    total = F.col("nuclear_mw") + F.col("wind_mw") + F.col("hydro_mw") + 3
    p, e = [(F.col(c) + 1) / total for c in ("nuclear_mw", "wind_mw", "hydro_mw")], [F.col(c) for c in ("gas_mw", "coal_mw", "solar_mw")]
    gas = {f"gas_alpha{k}": models.mix_experts(models.sharpened(p, float(k)), e) for k in (2, 3, 5)}
    top = models.mix_experts(models.hard(p), e)
    return rounded(m.select("t", *[c.alias(n) for n, c in gas.items()], top.alias("gas_hard"), models.gate_variant(F.lit(50.0), top, F.col("gas_mw"), F.lit(10000.0)).alias("variant_hard")))


@query("""r as (select origin, horizon, target, prediction as value, actual from predictions where model = 'd2'), o as (select distinct origin as og from r),
g as (select og, s, avg(abs(value * (s / 100.0::double) - actual) / greatest(abs(actual), 1e-9)) as l, count(*) as n from o join r on r.origin < og and r.target < og and r.origin >= og - 14 * 86400 and r.target >= og - 14 * 86400, range(70, 131) q(s) group by 1, 2),
b as (select og, arg_min(s, (round(l, 12), s)) / 100.0::double as raw, max(n) as n from g group by 1)
select og as origin, round(coalesce(raw, 0.93), 6) as recent, round(0.93 + 0.75 * (coalesce(raw, 0.93) - 0.93), 6) as scale, coalesce(n, 0) as n from o left join b using (og)""")
def m_scale(spark, d):
    p = ad.predictions(spark, d, {"d2": 48}).withColumnRenamed("prediction", "value").drop("model")
    return rounded(gate.recent_scale(p))


def _training(spark, d):
    m = ad.mix_hourly(spark, d, True)
    lag = ad.hourly(spark, d).select((F.col("t") + 86400).alias("t"), F.col("carbon").alias("lag24"))
    return m.join(lag, "t").withColumn("hour", F.expr("t div 3600 % 24").cast("double")).withColumn("regime", se.regime(F.col("gas_mw"), 50, 250)).withColumn("y", se.proxy_intensity()).filter("y is not null")


@query()
def m_direct_moe(spark, d):
    t = _training(spark, d)
    cut = 1706140800
    predict = models.fit_regime_experts(t.filter(F.col("t") < cut), ["lag24", "hour", "nuclear_mw", "wind_mw", "solar_mw"], "y", "regime", trees=250, step=0.04)
    return rounded(predict(t.filter(F.col("t") >= cut)).select("t", "p0", "p1", "p2", "prediction", "y"))


@query()
def m_physical_moe(spark, d):
    t = _training(spark, d)
    cut, x = 1706140800, ["lag24", "hour", "nuclear_mw", "wind_mw"]
    t = t.withColumn("total_generation_mw", sum((F.greatest(c, F.lit(0.0)) for c in se.PARTS), F.lit(0.0)))
    predict = models.fit_physical_experts(t.filter(F.col("t") < cut), x, "regime", "y", "t")
    return rounded(predict(t.filter(F.col("t") >= cut)).select("t", "prediction", "denominator", "y"))


def _ridge(train: pd.DataFrame, test: pd.DataFrame) -> pd.Series:
    x = lambda p: np.column_stack([np.ones(len(p)), p["lag48"], p["lag168"]])
    a = x(train)
    w = np.linalg.solve(a.T @ a + np.eye(3), a.T @ train["actual"].to_numpy())
    return pd.Series(x(test) @ w, index=test.index)


@query()
def m_daily_refit(spark, d):
    p = ad.predictions(spark, d)
    wide = p.groupBy("origin", "horizon", "target", "actual").agg(F.max(F.when(F.col("model") == "d2", F.col("prediction"))).alias("lag48"), F.max(F.when(F.col("model") == "d7", F.col("prediction"))).alias("lag168"))
    return rounded(models.refit_per_origin(wide, ["lag48", "lag168"], _ridge))


_MET = """round(100.0::double * avg(abs(prediction - actual) / abs(actual)), 6) as mape, round(100.0::double * sum(abs(prediction - actual)) / sum(abs(actual)), 6) as wape, round(avg(abs(prediction - actual)), 6) as mae, round(sqrt(avg((prediction - actual) ** 2)), 6) as rmse,
  round(avg(prediction - actual), 6) as bias, round(avg(actual), 6) as mean_actual, round(avg(prediction), 6) as mean_prediction, count(*) as n"""


@query(f"select model, {_MET} from predictions where actual > 0 group by 1")
def p_metrics(spark, d):
    return rounded(gate.metrics(ad.predictions(spark, d), ["model"]))


@query(f"select model, {_MET} from (select * replace (actual - 10 as actual) from predictions) where actual <> 0 group by 1")
def p_metrics_signed(spark, d):
    p = ad.predictions(spark, d).withColumn("actual", F.col("actual") - 10).filter("actual <> 0")
    return rounded(gate.metrics(p, ["model"], signed=True))


@query(f"select model, block, horizon, grouping(model, block, horizon) as level, {_MET} from (select *, case when horizon <= 7 then 0 when horizon <= 15 then 1 when horizon <= 21 then 2 else 3 end as block from predictions where actual > 0) group by grouping sets ((), (model), (block), (horizon))")
def p_grouping_sets(spark, d):
    return rounded(gate.metrics_by_sets(ad.predictions(spark, d).withColumn("block", gate.block(F.col("horizon"))), ["model", "block", "horizon"]))


@query("""select origin, round(a, 6) as candidate, round(b, 6) as reference, round(a - b, 6) as delta from (select origin, 100.0::double * avg(abs(prediction - actual) / actual) filter (model = 'd2') as a, 100.0::double * avg(abs(prediction - actual) / actual) filter (model = 'd7') as b from predictions where actual > 0 group by 1)""")
def p_paired_ape(spark, d):
    return rounded(gate.paired_errors(ad.predictions(spark, d), "d2", "d7"))


@query("""p as (select origin, 100.0::double * avg(abs(prediction - actual) / actual) filter (model = 'd2') as a, 100.0::double * avg(abs(prediction - actual) / actual) filter (model = 'd7') as b from predictions where actual > 0 group by 1)
select round(avg(a - b), 6) as mean_delta, round(100.0::double * avg((a < b)::int::double), 6) as better_pct, count(*) as origins from p""")
def p_paired_summary(spark, d):
    return rounded(gate.paired_summary(gate.paired_errors(ad.predictions(spark, d), "d2", "d7")))


@query()
def p_paired_interval(spark, d):
    """Interval of the mean difference by a bootstrap of blocks of seven origins."""
    from ..operators.exhaustive import block_bootstrap

    pairs = gate.paired_errors(ad.predictions(spark, d), "d2", "d7").withColumn("series", F.lit("d2-d7"))
    return rounded(block_bootstrap(pairs, ["series"], "origin", "delta", block=7))
