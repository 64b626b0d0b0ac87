"""Queries S*, R*, K* and the summary of documents, with SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as ad
from ..adapters import oracle
from ..operators import metricsql as mq
from ..session import shared_folder
from ..sources import records, sinks
from ..streaming import live
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


def _iso(t):
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _message_json(spark, d):
    m = ad.messages(spark, d)
    v = F.struct(_iso("start").alias("start_date"), _iso("end").alias("end_date"), F.lit("x").alias("available_capacity"), F.col("mw").cast("string").alias("unavailable_capacity"))
    head = [F.col("identifier").cast("string").alias("identifier"), "message_id", F.col("version").cast("string").alias("version"), _iso("pub").alias("publication_date"), F.col("status").alias("event_status"), F.col("kind").alias("unavailability_type"), F.col("fuel").alias("fuel_type")]
    g = m.groupBy("message_id").agg(F.collect_list(v).alias("values"), *[F.max(c if isinstance(c, str) else c).alias(n) for c, n in zip(head, ["identifier", "mid", "version", "publication_date", "event_status", "unavailability_type", "fuel_type"]) if n != "mid"])
    return g.select(F.to_json(F.struct("identifier", "message_id", "version", "publication_date", "event_status", "unavailability_type", "fuel_type", "values")).alias("value"), F.col("message_id").alias("seq"))


@query("""u as (select distinct on (message_id, start, "end") message_id, start, "end" from messages) select message_id, start * 1000000 as interval_start, "end" * 1000000 as interval_end from u""")
def s_outage_flatten(spark, d):
    return records.outage_messages(_message_json(spark, d)).select("message_id", "interval_start", "interval_end")


@query("""select production_type, target * 1000000 as target, updated * 1000000 as updated, max(value) as value_mw from vintages group by 1, 2, 3""")
def s_generation_flatten(spark, d):
    v = ad.vintages(spark, d)
    e = F.struct(F.col("value").alias("o"), _iso("target").alias("start_date"), _iso("target").alias("end_date"), _iso("updated").alias("updated_date"), F.col("value").cast("string").alias("value"))
    g = v.groupBy("production_type", F.expr("target div 2592000").alias("m")).agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: F.struct(x["start_date"].alias("start_date"), x["end_date"].alias("end_date"), x["updated_date"].alias("updated_date"), x["value"].alias("value"))).alias("values"))
    p = g.select(F.to_json(F.struct(F.lit("D-1").alias("type"), "production_type", F.lit("x").alias("sub_type"), "values")).alias("value"), F.col("m").alias("seq"))
    return records.generation_forecasts(p).select("production_type", "target", "updated", "value_mw")


@query("""select t * 1000000 as start, case border when 'GERMANY' then 'DE' when 'FRANCE' then 'IT' else border end as border, direction, round(sum(mw), 6) as value_mw, count(*) as n from schedules group by 1, 2, 3""")
def s_exchange_flatten(spark, d):
    s = ad.schedules(spark, d)
    code = F.when(F.col("border") == "GERMANY", "10YCB-GERMANY--8").when(F.col("border") == "FRANCE", "10YIT-GRTN-----B").otherwise(F.col("border"))
    own, out = F.lit("10YFR-RTE------C"), F.col("direction") == "export"
    v = F.array(F.struct(_iso("t").alias("start_date"), _iso("t").alias("end_date"), F.col("mw").cast("string").alias("value")))
    p = s.select(F.to_json(F.struct(F.when(out, own).otherwise(code).alias("sender_country_eic_code"), F.when(out, code).otherwise(own).alias("receiver_country_eic_code"), _iso("updated").alias("updated_date"), v.alias("values"))).alias("value"))
    r = records.exchange_schedules(p).groupBy("start", "border", "direction").agg(F.sum("value_mw").alias("value_mw"), F.count("*").alias("n"))
    return rounded(r)


@query("select event_type, h as t, round(avg(value), 6) as price from ev group by 1, 2")
def s_array_series(spark, d):
    e = ad.events(spark, d).withColumn("s", F.expr("us div 1000000")).groupBy("event_type", F.expr("us div 86400000000").alias("day")).agg(F.collect_list(F.struct("s", "value")).alias("x"))
    p = e.select(F.to_json(F.struct("event_type", F.col("x.s").alias("unix_seconds"), F.col("x.value").alias("price"))).alias("value"))
    return rounded(records.array_series(p, "price", key="event_type"))


@query("""l as (select event_type, h, arg_max(value, (event_id, us)) as v from ev group by 1, 2)
select h as t, round(max(v) filter (event_type = 'click'), 6) as wind_mw, round(max(v) filter (event_type = 'view'), 6) as solar_mw from l where event_type in ('click', 'view') group by 1""")
def s_array_mix(spark, d):
    """Two kinds outer joined on the hour; of values delivered twice the last counts."""
    e = ad.events(spark, d)
    p = e.select(F.to_json(F.struct("event_type", F.array("h").alias("unix_seconds"), F.array("value").alias("price"))).alias("value"), F.col("event_id").alias("seq"))
    return rounded(records.array_mix(p, "price", "event_type", {"click": "wind_mw", "view": "solar_mw"}, sequence="seq"))


@query("l as (select us // 1000000 as s, arg_max(value, event_id) as v from ev group by 1) select s // 3600 * 3600 as t, round(avg(v), 6) as consumption_day_ahead_mw from l group by 1")
def s_consumption_forecast(spark, d):
    r = ad.events(spark, d).select(F.expr("us div 1000000").alias("t"), F.to_json(F.struct(F.col("value").alias("prevision_j1"))).alias("value"), F.col("event_id").alias("seq"))
    return rounded(records.record_series(r, records.DAY_AHEAD, "seq"))


@query("select user_id::varchar as pod, event_type as kind, count(*) as n, round(sum(value), 6) as total from ev group by 1, 2")
def s_json_matrix(spark, d):
    e = ad.events(spark, d).groupBy("user_id", "event_type").agg(F.collect_list(F.array((F.col("us") / 1e6).cast("string"), F.col("value").cast("string"))).alias("values"))
    row = F.struct(F.create_map(F.lit("pod"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")).alias("metric"), "values")
    p = e.groupBy("event_type").agg(F.collect_list(row).alias("result")).select(F.to_json(F.struct(F.struct("result").alias("data"))).alias("value"))
    m = mq.select(records.metric_matrix(p))
    return rounded(m.groupBy(F.element_at("labels", "pod").alias("pod"), F.element_at("labels", "kind").alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("select event_id, json_extract(props, '$.k')::bigint as k from ev")
def s_json_path(spark, d):
    return ad.events(spark, d).select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""g as (select user_id, sum(value) as j, min(us) // 1000000 as a from ev group by 1)
select user_id::varchar as job_uid, 'ns' as namespace, 'job-' || user_id as job_name, 'succeeded' as outcome, strftime(to_timestamp(a) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as started_at, null::varchar as finished_at, null::double as duration_seconds, round(j, 6) as energy_joules,
  null::double as energy_kwh, null::double as average_power_watts, null::double as intensity, null::double as emissions_gco2eq, true as valid, true as final, null::double as energy_coverage_ratio, null::double as carbon_energy_coverage_ratio, null::int as counter_resets,
  null::boolean as clean_node, null::double as co_tenant_energy_share, null::varchar as image, null::varchar as image_id, null::varchar as stdout_sha256, 'w1 | w2' as warnings, '{"x/policy":"deferred"}' as labels_json, 'deferred' as policy from g where user_id % 2 = 0""")
def a_summary(spark, d):
    g = ad.events(spark, d).groupBy("user_id").agg(F.sum("value").alias("j"), F.min("us").alias("a"), F.max("us").alias("z"))
    doc = F.to_json(F.struct(
        F.struct(F.col("user_id").cast("string").alias("uid"), F.lit("ns").alias("namespace"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("name"), F.lit("succeeded").alias("outcome"), F.create_map(F.lit("x/policy"), F.lit("deferred")).alias("labels")).alias("job"),
        _iso(F.expr("a div 1000000")).alias("execution_started_at"), F.struct(F.col("j").alias("total_joules")).alias("energy"), F.struct((F.col("user_id") % 2 == 0).alias("valid"), (F.col("user_id") % 2 == 0).alias("final"), F.array(F.lit("w1"), F.lit("w2")).alias("warnings")).alias("quality"),
    ))
    return rounded(sinks.summarize_reports(g.select(doc.alias("value")), ["policy"], "x/"))


@query("select h as t, round(avg(value), 6) as value, count(*) as n from ev group by 1")
def r_hourly_means(spark, d):
    ad.table(spark, d, "events")
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    s = raw.select(F.lit("FR").alias("zone"), F.col("ts").cast("timestamp").alias("time"), "value")
    return rounded(live.drained(live.hourly_means(s, ["zone"], "time", "value"), shared_folder(spark), "complete").drop("zone"))


@query("select user_id, arg_max(event_id, (us, event_id)) as event_id from ev group by 1")
def r_latest_state(spark, d):
    ad.table(spark, d, "events")
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    s = live.latest_state(raw.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], ["event_id"])
    return live.drained(s, shared_folder(spark), "complete")


@query("""p as (select event_id, us / 1e6 as ts, value from ev where event_type <> 'signup'), c as (select us / 1e6 as ts, max(value) as v from ev where event_type = 'signup' group by 1)
select p.event_id % 10 as bucket, count(*) as n, count(case when p.ts - c.ts <= 5400 then 1 end) as fresh, round(sum(case when p.ts - c.ts <= 5400 then p.value * c.v end) / 1000, 3) as total from p asof left join c on p.ts >= c.ts group by 1""".replace("p.event_id % 10 as bucket", "0::bigint as bucket"))
def r_stream_rules(spark, d):
    ad.table(spark, d, "events")
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    s = raw.select(F.lit("FR").alias("zone"), (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("ts"), F.when(F.col("event_type") == "signup", "carbon").otherwise("power").alias("kind"), "value")
    r = live.drained(live.emission_rates(s), shared_folder(spark), "append")
    g = r.groupBy(F.lit(0).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"), F.count("rate").alias("fresh"), (F.sum("rate") * 3600).alias("total"))
    return g.withColumn("total", F.round("total", 3))
