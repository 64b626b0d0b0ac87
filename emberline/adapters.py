"""The driver's tables as views of this domain, and the same views as SQL for the oracle.

Times are epoch seconds (bigint ``t``), so nothing depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400
#: Origins of the synthetic predictions: 21 days from 2024-01-09, 00:00 UTC.
FIRST_ORIGIN, ORIGINS = 1_704_758_400, 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column that holds UTC."""
    return F.expr(f"unix_micros(cast({column} as timestamp))")


def seconds(column: str) -> Column:
    return F.expr(f"unix_micros(cast({column} as timestamp)) div 1000000")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", micros("ts").alias("us"))
    return e.withColumn("h", F.expr("us div 3600000000 * 3600"))


def carbon_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One global series ``zone, t, carbon`` with the hours that have events."""
    return events(spark, sf_dir).groupBy(F.lit("FR").alias("zone"), F.col("h").alias("t")).agg(F.avg("value").alias("carbon"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without gaps: missing hours hold the mean of all."""
    from .operators.series import regularize

    full = regularize(carbon_hourly(spark, sf_dir), ["zone"], "t", HOUR)
    mean = F.avg("carbon").over(W.partitionBy("zone"))
    return full.select("zone", "t", F.coalesce("carbon", mean).alias("carbon"))


#: The mix: which events stand for which source of power.
MIX = {
    "nuclear_mw": ("click", 0), "wind_mw": ("click", 1), "hydro_mw": ("view", 0), "solar_mw": ("view", 1),
    "gas_mw": ("purchase", 0), "bioenergy_mw": ("purchase", 1), "coal_mw": ("signup", None), "fuel_oil_mw": ("error", None),
}


def mix_hourly(spark: SparkSession, sf_dir: str, filled: bool = False) -> DataFrame:
    cond = {c: (F.col("event_type") == k) & (F.lit(True) if odd is None else F.col("event_id") % 2 == odd) for c, (k, odd) in MIX.items()}
    mix = events(spark, sf_dir).groupBy(F.col("h").alias("t")).agg(*[F.sum(F.when(x, F.col("value"))).alias(c) for c, x in cond.items()])
    return mix.fillna(0.0, list(MIX)) if filled else mix


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pod, ts`` (epoch seconds, double), ``joules``: a counter per user that starts anew every week."""
    week = F.expr("us div 1000000 div 604800")
    w = W.partitionBy("user_id", week).orderBy("us", "event_id")
    return events(spark, sf_dir).select(F.col("user_id").alias("pod"), (F.col("us") / 1e6).alias("ts"), F.sum("value").over(w).alias("joules"))


def job_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("pod")).agg((F.min("us") / 1e6 + DAY).alias("start"), (F.max("us") / 1e6 - DAY).alias("end"))


def power_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("series"), (F.col("us") / 1e6).alias("ts"), F.col("value").alias("watts"))


def kepler_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pod, ts, joules, seq``: the energy counters of the metric matrix, one key per series and capture, in order of delivery."""
    from .operators.regrid import finite_number

    s = table(spark, sf_dir, "kepler_samples").filter(F.col("metric_name").endswith("_total"))
    return s.select(F.concat_ws("#", "series_id", "capture_id").alias("pod"), (F.unix_micros("sample_ts") / 1e6).alias("ts"), finite_number(F.col("sample_value")).alias("joules"), F.col("sample_id").alias("seq"))


def kepler_pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pod, job, start, end``: every counter of a capture over the capture, a minute less at both ends; the capture is the job."""
    s = table(spark, sf_dir, "kepler_samples").filter(F.col("metric_name").endswith("_total")).select("series_id", "capture_id").distinct()
    c = table(spark, sf_dir, "capture_runs").select("capture_id", (F.unix_micros("started_at") / 1e6 + 60).alias("start"), (F.unix_micros("ended_at") / 1e6 - 60).alias("end"))
    return s.join(c, "capture_id").select(F.concat_ws("#", "series_id", "capture_id").alias("pod"), F.col("capture_id").alias("job"), "start", "end")


def area_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``zone, t, carbon``: the valid points of production accounting, of those of one area and instant the last delivered."""
    from .operators.skew import clean_key

    v = F.col("carbon_intensity_gco2_kwh")
    p = table(spark, sf_dir, "carbon_points").filter((clean_key("basis") == "PRODUCTION") & (v >= 0) & (v < float("inf")))
    d = p.select(clean_key("area_code").alias("zone"), (F.unix_micros("point_ts") / 1e6).alias("t"), "point_id", v.alias("carbon")).dropna(subset=["zone", "t"])
    return d.groupBy("zone", "t").agg(F.max_by("carbon", "point_id").alias("carbon"))


def area_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_points(spark, sf_dir).groupBy("zone", (F.floor(F.col("t") / HOUR).cast("long") * HOUR).alias("t")).agg(F.avg("carbon").alias("carbon"))


def outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the outage messages that aren't void, deliveries of the same only once; times in epoch seconds."""
    from .operators.skew import clean_key

    d = table(spark, sf_dir, "outage_messages").select(
        clean_key("identifier").alias("identifier"), "message_id", "version", seconds("publication_date").alias("pub"), clean_key("event_status").alias("status"), clean_key("unavailability_type").alias("kind"), clean_key("fuel_type").alias("fuel"),
        seconds("interval_start").alias("start"), seconds("interval_end").alias("end"), F.col("unavailable_capacity_mw").alias("mw"),
    )
    return d.dropna(subset=["identifier", "version", "pub", "start", "end", "mw"]).distinct()


def publication_days(messages: DataFrame) -> DataFrame:
    """``origin``: every midnight (UTC) from the first publication's day to the last one's."""
    day = lambda f: F.floor(f("pub") / DAY).cast("long") * DAY
    return messages.agg(day(F.min).alias("a"), day(F.max).alias("z")).filter("a is not null").select(F.explode(F.sequence("a", "z", F.lit(DAY))).alias("origin"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of windows as ``model, origin, duration, start, end, predicted, actual``: of windows delivered again the last, those without a cost left out."""
    c = table(spark, sf_dir, "window_catalog")
    row = F.struct("catalog_id", F.col("end_horizon").alias("end"), F.col("predicted_window_cost").alias("predicted"), F.col("actual_window_cost").alias("actual"))
    d = c.groupBy("model", micros("origin").alias("_o"), F.col("duration_hours").alias("duration"), F.col("start_horizon").alias("start")).agg(F.max_by(row, "catalog_id").alias("r"))
    d = d.select("model", F.expr("_o div 1000000").alias("origin"), "duration", "start", "r.end", "r.predicted", "r.actual")
    return d.filter("not isnan(predicted) and not isnan(actual) and predicted is not null and actual is not null")


def origins(spark: SparkSession) -> DataFrame:
    return spark.range(ORIGINS).select((F.col("id") * DAY + FIRST_ORIGIN).alias("origin"))


def predictions(spark: SparkSession, sf_dir: str, lags: dict[str, int] | None = None, horizons: int = 24) -> DataFrame:
    """``model, origin, horizon, target, prediction, actual``: persistence models over the gapless series."""
    h = hourly(spark, sf_dir).select("t", "carbon")
    out = None
    for model, lag in (lags or {"d2": 48, "d7": 168}).items():
        d = origins(spark).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn("target", F.col("origin") + F.col("horizon") * HOUR)
        d = d.withColumn("src", F.col("target") - lag * HOUR)
        d = d.join(h.withColumnsRenamed({"t": "src", "carbon": "prediction"}), "src").join(h.withColumnsRenamed({"t": "target", "carbon": "actual"}), "target")
        d = d.select(F.lit(model).alias("model"), "origin", "horizon", "target", "prediction", "actual")
        out = d if out is None else out.unionByName(d)
    return out


def _orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", seconds("l_shipdate").alias("ship"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), seconds("o_orderdate").alias("pub"))
    return li.join(o, "l_orderkey")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("p_type"))
    d = _orders_lines(spark, sf_dir).join(part, "l_partkey")
    fuel = F.element_at(F.array(*[F.lit(x) for x in FUELS]), (F.pmod(F.length("p_type"), F.lit(len(FUELS))) + 1).cast("int"))
    return d.select(
        F.col("l_partkey").alias("identifier"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("message_id"), F.col("l_linenumber").alias("version"), "pub",
        F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("DISMISSED").alias("status"), F.when(F.col("l_returnflag") == "N", "UNPLANNED").otherwise("PLANNED").alias("kind"), fuel.alias("fuel"),
        F.col("ship").alias("start"), (F.col("ship") + F.col("l_quantity").cast("long") * DAY).alias("end"), (F.col("l_quantity") * 10.0).cast("double").alias("mw"),
    )


#: Fuel types as the messages spell them; by the length of the part's type.
FUELS = ["NUCLEAR", "FOSSIL_GAS", "HYDRO_WATER_RESERVOIR", "FOSSIL_HARD_COAL", "OTHER"]


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "WIND_ONSHORE").when(F.col("l_returnflag") == "N", "WIND_OFFSHORE").otherwise("SOLAR")
    return _orders_lines(spark, sf_dir).select(kind.alias("production_type"), F.col("ship").alias("target"), F.col("pub").alias("updated"), F.col("l_quantity").cast("double").alias("value"), "l_orderkey", "l_linenumber", "l_partkey")


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("border"))
    d = _orders_lines(spark, sf_dir).join(s, "l_suppkey")
    way = F.when(F.col("l_returnflag") == "A", "export").otherwise("import")
    return d.select((F.col("ship") + F.col("l_linenumber") * 900).alias("t"), "border", way.alias("direction"), F.col("pub").alias("updated"), F.col("l_quantity").cast("double").alias("mw"), "l_orderkey", "l_linenumber", "l_partkey")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg((F.count("*") * 60).cast("double").alias("runtime"))
    t = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("policy"), (F.col("o_orderstatus") != "P").alias("valid"), F.col("o_totalprice").cast("double").alias("energy"), (F.col("o_custkey") % 10).alias("seed"))
    return t.join(n, "run_id")


#: The views above for DuckDB; every oracle query begins with them.
BASE = rf"""
ev as (select event_id, user_id, event_type, value, props, epoch_us(ts) as us, epoch_us(ts) // 3600000000 * 3600 as h from events),
carbon_hourly as (select h as t, avg(value) as carbon from ev group by 1),
grid as (select unnest(range((select min(t) from carbon_hourly), (select max(t) from carbon_hourly) + 1, 3600)) as t),
hourly as (select g.t, coalesce(c.carbon, (select avg(carbon) from carbon_hourly)) as carbon from grid g left join carbon_hourly c on c.t = g.t),
mix as (select h as t, {', '.join(f"sum(value) filter (event_type = '{k}'{'' if odd is None else f' and event_id % 2 = {odd}'}) as {c}" for c, (k, odd) in MIX.items())} from ev group by 1),
mix_filled as (select t, {', '.join(f'coalesce({c}, 0.0::double) as {c}' for c in MIX)} from mix),
counters as (select user_id as pod, us / 1e6 as ts, sum(value) over (partition by user_id, us // 1000000 // 604800 order by us, event_id) as joules from ev),
job_windows as (select user_id as pod, min(us) / 1e6 + 86400 as start, max(us) / 1e6 - 86400 as "end" from ev group by 1),
origins as (select {FIRST_ORIGIN}::bigint + i * 86400 as origin from range({ORIGINS}) r(i)),
stack as (select origin, h::int as horizon, origin + h * 3600 as target from origins, range(1, 25) r(h)),
predictions as (
  select m.model, s.origin, s.horizon, s.target, p.carbon as prediction, a.carbon as actual
  from stack s, (values ('d2', 48), ('d7', 168)) m(model, lag) join hourly p on p.t = s.target - m.lag * 3600 join hourly a on a.t = s.target),
lines as (select l.*, epoch_us(l_shipdate::timestamp) // 1000000 as ship, epoch_us(o_orderdate::timestamp) // 1000000 as pub from lineitem l join orders o on o.o_orderkey = l.l_orderkey),
messages as (
  select l_partkey as identifier, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as message_id, l_linenumber as version, pub, case when l_linestatus = 'O' then 'ACTIVE' else 'DISMISSED' end as status,
    case when l_returnflag = 'N' then 'UNPLANNED' else 'PLANNED' end as kind, {FUELS!r}[length(p_type) % {len(FUELS)} + 1] as fuel, ship as start, ship + l_quantity::bigint * 86400 as "end", l_quantity * 10.0::double as mw
  from lines join part on p_partkey = l_partkey),
vintages as (
  select case l_returnflag when 'A' then 'WIND_ONSHORE' when 'N' then 'WIND_OFFSHORE' else 'SOLAR' end as production_type, ship as target, pub as updated, l_quantity::double as value, l_orderkey, l_linenumber, l_partkey from lines),
schedules as (
  select ship + l_linenumber * 900 as t, n_name as border, case when l_returnflag = 'A' then 'export' else 'import' end as direction, pub as updated, l_quantity::double as mw, l_orderkey, l_linenumber, l_partkey
  from lines join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
kcounters as (select concat_ws('#', series_id, capture_id) as pod, epoch_us(sample_ts) / 1e6 as ts, try_cast(trim(sample_value) as double) as joules, sample_id as seq from kepler_samples
  where metric_name like '%\_total' escape '\' and regexp_full_match(trim(sample_value), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and isfinite(try_cast(trim(sample_value) as double))),
kpods as (select distinct concat_ws('#', series_id, s.capture_id) as pod, s.capture_id as job, epoch_us(started_at) / 1e6 + 60 as start, epoch_us(ended_at) / 1e6 - 60 as "end" from kepler_samples s join capture_runs c on c.capture_id = s.capture_id where metric_name like '%\_total' escape '\'),
area_points as (select upper(trim(area_code)) as zone, epoch_us(point_ts) / 1e6 as t, arg_max(carbon_intensity_gco2_kwh, point_id) as carbon from carbon_points
  where upper(trim(basis)) = 'PRODUCTION' and isfinite(carbon_intensity_gco2_kwh) and carbon_intensity_gco2_kwh >= 0 and area_code is not null and point_ts is not null group by 1, 2),
area_hourly as (select zone, floor(t / 3600)::bigint * 3600 as t, avg(carbon) as carbon from area_points group by 1, 2),
outages as (select distinct upper(trim(identifier)) as identifier, message_id, version, epoch_us(publication_date) // 1000000 as pub, upper(trim(event_status)) as status, upper(trim(unavailability_type)) as kind, upper(trim(fuel_type)) as fuel,
    epoch_us(interval_start) // 1000000 as start, epoch_us(interval_end) // 1000000 as "end", unavailable_capacity_mw as mw
  from outage_messages where identifier is not null and version is not null and publication_date is not null and interval_start is not null and interval_end is not null and unavailable_capacity_mw is not null),
pub_days as (select unnest(range(min(pub) // 86400 * 86400, max(pub) // 86400 * 86400 + 1, 86400)) as origin from outages),
candidates as (select model, epoch_us(origin) // 1000000 as origin, duration_hours as duration, start_horizon as start, end_horizon as "end", predicted_window_cost as predicted, actual_window_cost as actual from (
    select *, row_number() over (partition by model, origin, duration_hours, start_horizon order by catalog_id desc) as k from window_catalog)
  where k = 1 and predicted_window_cost is not null and actual_window_cost is not null and not isnan(predicted_window_cost) and not isnan(actual_window_cost)),
trials as (
  select o_orderkey as run_id, o_orderpriority as policy, o_orderstatus <> 'P' as valid, o_totalprice::double as energy, o_custkey % 10 as seed, n * 60::double as runtime
  from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey)
"""


def oracle(sql: str) -> str:
    """A query over the views; further common tables may come first."""
    sql = sql.strip()
    return f"with {BASE}{', ' + sql if not sql.lower().startswith(('select', '(select')) else sql}"
