"""Parsers of the providers' payloads: nested JSON or TSV in, tidy rows out.

Inputs are DataFrames with a text column (one payload per row), so a folder of saved responses, a table or a stream can feed them. Unreadable payloads
and values become null or no row, never an error, unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import finite, keep_last, resample

# Names of the national grid's open data and this library's canonical names.
CANONICAL = {
    "taux_co2": "carbon_intensity_gco2_kwh", "consommation": "consumption_mw", "nucleaire": "nuclear_mw", "gaz": "gas_mw", "charbon": "coal_mw", "fioul": "fuel_oil_mw", "eolien": "wind_mw", "solaire": "solar_mw",
    "hydraulique": "hydro_mw", "bioenergies": "bioenergy_mw", "pompage": "pumped_storage_mw", "ech_physiques": "physical_exchange_mw", "eolien_terrestre": "wind_onshore_mw", "eolien_offshore": "wind_offshore_mw",
    "fioul_tac": "fuel_oil_turbine_mw", "fioul_cogen": "fuel_oil_cogeneration_mw", "fioul_autres": "fuel_oil_other_mw", "gaz_tac": "gas_turbine_mw", "gaz_cogen": "gas_cogeneration_mw", "gaz_ccg": "gas_ccg_mw", "gaz_autres": "gas_other_mw",
    "hydraulique_fil_eau_eclusee": "hydro_run_of_river_mw", "hydraulique_lacs": "hydro_reservoir_mw", "hydraulique_step_turbinage": "hydro_pumped_turbining_mw", "bioenergies_dechets": "bioenergy_waste_mw",
    "bioenergies_biomasse": "bioenergy_biomass_mw", "bioenergies_biogaz": "bioenergy_biogas_mw", "ech_comm_angleterre": "commercial_exchange_gb_mw", "ech_comm_espagne": "commercial_exchange_es_mw",
    "ech_comm_italie": "commercial_exchange_it_mw", "ech_comm_suisse": "commercial_exchange_ch_mw", "ech_comm_allemagne_belgique": "commercial_exchange_de_be_mw", "stockage_batterie": "battery_charging_mw", "destockage_batterie": "battery_discharging_mw",
}
#: Fields of the rolling data set that the consolidated one doesn't know.
REALTIME_ONLY = ["eolien_terrestre", "eolien_offshore", "stockage_batterie", "destockage_batterie"]
# Energy identification codes of the neighbouring areas.
AREAS = {
    "10YFR-RTE------C": "FR", "10YIT-GRTN-----B": "IT", "10YBE----------2": "BE", "10YES-REE------0": "ES", "10YCH-SWISSGRIDZ": "CH", "10YCB-GERMANY--8": "DE", "10Y1001C--000255": "GB_IFA", "10Y1001C--000344": "GB_ELECLINK", "10Y1001C--000263": "GB_IFA2",
}


def _time(c: str) -> Column:
    return F.unix_micros(F.try_to_timestamp(F.col(c).cast("string")))


def _number(c: str) -> Column:
    return finite(F.col(c).cast("string").try_cast("double"))


def outage_messages(payloads: DataFrame, text: str = "value", sequence: str = "seq") -> DataFrame:
    """One row per message and capacity interval; a message without intervals gives one row without bounds. Of equal (message, bounds) the last counts.

    Times are epoch microseconds. ``sequence`` orders the payloads.
    """
    schema = "identifier string, message_id string, version string, publication_date string, event_status string, unavailability_type string, fuel_type string, values array<struct<start_date:string,end_date:string,available_capacity:string,unavailable_capacity:string>>"
    d = payloads.select(F.col(sequence).alias("_seq"), F.from_json(text, schema).alias("m")).select("_seq", "m.*").filter("message_id is not null")
    d = d.select("*", F.posexplode_outer("values").alias("_pos", "v")).drop("values")
    d = d.select(
        "identifier", "message_id", F.col("version").try_cast("int").alias("version"), _time("publication_date").alias("publication"), "event_status", "unavailability_type", "fuel_type", _time("v.start_date").alias("interval_start"),
        _time("v.end_date").alias("interval_end"), _number("v.available_capacity").alias("available_mw"), _number("v.unavailable_capacity").alias("unavailable_mw"), "_seq", F.coalesce("_pos", F.lit(0)).alias("_pos"),
    )
    return keep_last(d, ["message_id", "interval_start", "interval_end"], ["_seq", "_pos"]).drop("_seq", "_pos")


def generation_forecasts(payloads: DataFrame, text: str = "value", sequence: str = "seq") -> DataFrame:
    """One row per forecast value; of equal (types, target, update) the last counts. Forecasts without values give no rows."""
    schema = "type string, production_type string, sub_type string, start_date string, end_date string, values array<struct<start_date:string,end_date:string,updated_date:string,value:string>>"
    d = payloads.select(F.col(sequence).alias("_seq"), F.from_json(text, schema).alias("m")).select("_seq", "m.*")
    d = d.select("_seq", F.col("type").alias("forecast_type"), "production_type", "sub_type", F.posexplode("values").alias("_pos", "v"))
    d = d.select("forecast_type", "production_type", "sub_type", _time("v.start_date").alias("target"), _time("v.updated_date").alias("updated"), _number("v.value").alias("value_mw"), "_seq", "_pos")
    return keep_last(d, ["forecast_type", "production_type", "sub_type", "target", "updated"], ["_seq", "_pos"]).drop("_seq", "_pos")


def exchange_schedules(payloads: DataFrame, text: str = "value") -> DataFrame:
    """One row per scheduled value: export if France sends, else import; unknown codes stay as they are, a missing value is 0."""
    schema = "sender_country_eic_code string, receiver_country_eic_code string, updated_date string, values array<struct<start_date:string,end_date:string,value:string>>"
    label = F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv])
    name = lambda c: F.coalesce(F.element_at(label, c), c)
    d = payloads.select(F.from_json(text, schema).alias("m")).select("m.*").withColumn("v", F.explode("values"))
    out = F.coalesce(F.element_at(label, F.col("sender_country_eic_code")) == "FR", F.lit(False))
    return d.select(_time("v.start_date").alias("start"), F.when(out, name(F.col("receiver_country_eic_code"))).otherwise(name(F.col("sender_country_eic_code"))).alias("border"), F.when(out, "export").otherwise("import").alias("direction"), _time("updated_date").alias("updated"), F.coalesce(_number("v.value"), F.lit(0.0)).alias("value_mw"))


def array_series(payloads: DataFrame, value_field: str, text: str = "value", key: str | None = None, sequence: str | None = None) -> DataFrame:
    """Payloads of parallel arrays ``unix_seconds`` and a value array as hourly means; arrays of different lengths are an error.

    With ``sequence`` (the order of the payloads) of values at one instant only the last counts.
    """
    schema = f"unix_seconds array<bigint>, `{value_field}` array<double>" + (f", `{key}` string" if key else "")
    d = payloads.select(F.from_json(text, schema).alias("m"), *([F.col(sequence).alias("_seq")] if sequence else [])).select("m.*", *(["_seq"] if sequence else []))
    ok = F.assert_true(F.size("unix_seconds") == F.size(value_field), F.lit("times and values have different lengths"))
    d = d.withColumn("_z", F.when(ok.isNull(), F.arrays_zip("unix_seconds", value_field))).select("*", F.posexplode("_z").alias("_pos", "_e"))
    d = d.select(*([key] if key else []), F.col("_e.unix_seconds").alias("t"), F.col(f"_e.{value_field}").alias(value_field), *(["_seq", "_pos"] if sequence else []))
    if sequence:
        d = d.groupBy(*([key] if key else []), "t").agg(F.max_by(value_field, F.struct("_seq", "_pos")).alias(value_field))
    return resample(d, [key] if key else [], "t", 3600, {value_field: "avg"})


def array_mix(payloads: DataFrame, value_field: str, key: str, kinds: dict[str, str], text: str = "value", sequence: str | None = None) -> DataFrame:
    """Payloads of several kinds (in the field ``key``) as one frame: ``t`` and a column for each kind, outer joined on the hour: ``kinds`` gives the columns' names."""
    d = array_series(payloads, value_field, text, key, sequence)
    return d.filter(F.col(key).isin(list(kinds))).groupBy("t").agg(*[F.max(F.when(F.col(key) == k, F.col(value_field))).alias(n) for k, n in kinds.items()])


def record_series(records: DataFrame, columns: dict[str, str], sequence: str | None = None) -> DataFrame:
    """Records of ``emberline_records`` (``t``, JSON ``value``) as hourly means of the named fields; of records of one instant the last counts (by ``sequence``, else by their
    text), hours without any value are left out. The day-ahead consumption forecast is such a field (``DAY_AHEAD``), as are those of ``CANONICAL``."""
    fields = [finite(F.get_json_object("value", f"$.{f}").try_cast("double")).alias(n) for f, n in columns.items()]
    d = records.filter("t is not null").groupBy("t").agg(F.max_by("value", sequence or "value").alias("value")).select("t", *fields)
    return resample(d, [], "t", 3600, {n: "avg" for n in columns.values()}).dropna("all", subset=list(columns.values()))


# The open data's field of the day-ahead consumption forecast.
DAY_AHEAD = {"prevision_j1": "consumption_day_ahead_mw"}


def metric_matrix(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Samples ``labels, ts, value`` of range-query responses; values that are no number are null."""
    schema = "data struct<result:array<struct<metric:map<string,string>,values:array<array<string>>>>>"
    d = payloads.select(F.from_json(text, schema).alias("m")).select(F.explode("m.data.result").alias("r")).select("r.metric", F.explode("r.values").alias("p"))
    return d.select(F.col("metric").alias("labels"), F.get("p", F.lit(0)).try_cast("double").alias("ts"), finite(F.get("p", F.lit(1)).try_cast("double")).alias("value"))


def batch_objects(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Objects of the batch system: uid, name, namespace, labels, annotations, owners, phase, conditions, containers."""
    schema = """metadata struct<uid:string,name:string,namespace:string,labels:map<string,string>,annotations:map<string,string>,ownerReferences:array<struct<kind:string,uid:string>>>,
      spec struct<containers:array<struct<name:string,image:string,env:array<struct<name:string,value:string>>>>>, status struct<startTime:string,phase:string,succeeded:int,conditions:array<struct<type:string,status:string>>,containerStatuses:array<struct<name:string,imageID:string,restartCount:int>>>"""
    d = payloads.select(F.from_json(text, schema).alias("o")).select("o.*")
    return d.select("metadata.uid", "metadata.name", "metadata.namespace", "metadata.labels", "metadata.annotations", F.col("metadata.ownerReferences").alias("owners"), "status.startTime", "status.phase", "status.succeeded", "status.conditions", F.col("status.containerStatuses").alias("container_status"), F.col("spec.containers").alias("containers"))


def pods_of_jobs(pods: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pods owned by one of the jobs."""
    owner = F.get(F.filter(F.coalesce("owners", F.array().cast("array<struct<kind:string,uid:string>>")), lambda o: o["kind"] == "Job"), F.lit(0))["uid"]
    return pods.withColumn("job_uid", owner).join(jobs.select(F.col("uid").alias("job_uid")), "job_uid", "left_semi")


def provenance(pods: DataFrame) -> DataFrame:
    """Per container: image, image digest, restarts and the literal environment (variables without a literal value, such as secrets, are left out)."""
    c = pods.withColumn("c", F.explode("containers"))
    status = F.get(F.filter("container_status", lambda s: s["name"] == F.col("c.name")), F.lit(0))
    literal = F.filter(F.coalesce("c.env", F.array().cast("array<struct<name:string,value:string>>")), lambda e: e["value"].isNotNull())
    return c.select("uid", F.col("c.name").alias("container"), F.col("c.image").alias("image"), status["imageID"].alias("image_id"), status["restartCount"].alias("restarts"), F.map_from_entries(literal).alias("environment"))


def preflight(pods: DataFrame) -> DataFrame:
    """One row of findings: pods running, restarting more than thrice, and the blockers."""
    restarts = F.aggregate(F.coalesce("container_status", F.array().cast("array<struct<name:string,imageID:string,restartCount:int>>")), F.lit(0), lambda a, s: a + F.coalesce(s["restartCount"], F.lit(0)))
    d = pods.withColumn("_r", restarts)
    return d.agg(F.count("*").alias("pods"), F.sum((F.col("phase") == "Running").cast("long")).alias("running"), F.sum("_r").alias("restarts"), F.sum((F.col("_r") > 3).cast("long")).alias("crash_loops"), F.array_sort(F.collect_set(F.when(F.col("_r") > 3, F.col("name")))).alias("blockers"))


def monthly_tsv(spark: SparkSession, folder: str, dataset: str, months: list[str], area: str, value: str) -> DataFrame:
    """Hourly mean and latest update of an area in monthly tab-separated exports; only the wanted months' files are opened."""
    paths = [f"{folder}/{m}_{dataset}.csv" for m in months]
    raw = spark.read.option("sep", "\t").option("header", True).csv(paths).filter(F.col("AreaMapCode") == area)
    d = raw.select(F.unix_seconds(F.try_to_timestamp("`DateTime(UTC)`")).alias("t"), F.col(f"`{value}`").try_cast("double").alias("v"), F.unix_seconds(F.try_to_timestamp("`UpdateTime(UTC)`")).alias("updated"))
    return d.groupBy(F.expr("t div 3600 * 3600").alias("t")).agg(F.avg("v").alias("value"), F.max("updated").alias("updated")).dropna(subset=["t", "value"])


def snapshot(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, before: int = 7200, after: int = 1800) -> DataFrame:
    """A saved series (parquet or CSV; the time column is ``timestamp`` or else the first), from ``start - before`` to ``end + after`` inclusive."""
    d = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    column = "timestamp" if "timestamp" in d.columns else d.columns[0]
    t = F.unix_seconds(F.try_to_timestamp(F.col(column).cast("string")))
    if start is not None:
        d = d.filter(t >= start - before)
    if end is not None:
        d = d.filter(t <= end + after)
    return d.withColumnRenamed(column, "timestamp")


def metrics_csv(spark: SparkSession, path: str, metrics: list[str] | None = None) -> DataFrame:
    """Long sample files with their fixed schema; only the listed metrics."""
    d = spark.read.schema("query string, metric string, zone string, series string, ts double, value double").option("header", True).csv(path)
    return d.filter(F.col("metric").isin(metrics)) if metrics else d


def artefacts(spark: SparkSession, root: str, name: str, fields: dict[str, str]) -> DataFrame:
    """``run_id, path`` and fields (dotted paths) of the JSON document ``name`` of every run folder; absent fields are null."""
    d = spark.read.option("wholetext", True).text(f"{root}/*/{name}").withColumn("path", F.col("_metadata.file_path"))
    run = F.element_at(F.split("path", "/"), -2)
    return d.select(run.alias("run_id"), "path", *[F.get_json_object("value", f"$.{p}").alias(n) for n, p in fields.items()])


def completed(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all checkpoints written so far, the last per (origin, horizon)."""
    d = spark.read.parquet(folder)
    return keep_last(d.withColumn("_at", F.col("_metadata.file_modification_time")), ["origin", "horizon"], ["_at"]).drop("_at")
