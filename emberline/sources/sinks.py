"""Where results go: snapshots, one JSON document per job, summaries, checkpoints, text exposition."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import finite


def save_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """With ``order`` the rows come sorted by these columns: the only place where outputs are sorted."""
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").option("header", True).csv(path)


def save_checkpoints(predictions: DataFrame, folder: str) -> None:
    """One partition per origin day; days that are written again replace only themselves."""
    d = predictions.withColumn("origin_day", F.date_format(F.timestamp_seconds("origin"), "yyyy-MM-dd"))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin_day").parquet(folder)


def pending_origins(origins: DataFrame, done: DataFrame) -> DataFrame:
    """Origins without a checkpoint: what a resumed run has still to do."""
    return origins.join(done.select("origin").distinct(), "origin", "left_anti")


def safe_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON: numbers that aren't finite become null, nulls are kept."""
    clean = df.select(*[finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias(name))


def document_name(namespace: Column, name: Column, uid: Column) -> Column:
    return F.concat(F.regexp_replace(F.concat_ws("__", namespace, name), "[^a-zA-Z0-9_.-]+", "-"), F.lit("__"), uid)


def save_windows(catalog: DataFrame, decisions: DataFrame, aggregated: DataFrame, report: DataFrame, folder: str) -> None:
    """The outputs of an evaluation: catalogue and decisions as parquet, the table per model and duration as sorted CSV, the report as JSON lines."""
    save_snapshot(catalog, f"{folder}/catalog.parquet")
    save_snapshot(decisions, f"{folder}/decisions.parquet")
    save_csv(aggregated, f"{folder}/by_duration.csv", ["model", "duration"])
    safe_json(report, "value").write.mode("overwrite").text(f"{folder}/report.json")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_reports(reports: DataFrame, folder: str) -> int:
    """Reports (``job_uid, final`` and more) that have no final document yet, appended to ``folder``.

    The last report of a job in the batch counts (final ones first). A final document is never written twice; provisional ones may be followed by later versions. One
    writer at a time is assumed. Returns the number of rows written.
    """
    from ..operators.series import keep_last
    from ..session import checkpointed

    spark = reports.sparkSession
    order = ["final", *(["finished_at"] if "finished_at" in reports.columns else [])]
    reports = keep_last(reports, ["job_uid"], order)
    if exists(spark, folder):
        done = spark.read.parquet(folder).filter("final").select("job_uid").distinct()
        reports = reports.join(done, "job_uid", "left_anti")
    fresh = checkpointed(reports)  # the folder that is read is the one that is written
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(folder)
    return n


def read_reports(spark: SparkSession, folder: str, provisional: bool = False) -> DataFrame:
    """The last report per job, final ones first; provisional ones only if asked for."""
    from pyspark.sql import Window as W

    d = spark.read.parquet(folder)
    d = d if provisional else d.filter("final")
    w = W.partitionBy("job_uid").orderBy(F.col("final").desc(), F.col("finished_at").desc_nulls_last())
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def summarize_reports(documents: DataFrame, labels: list[str], prefix: str, text: str = "value", provisional: bool = False) -> DataFrame:
    """Comparison table of report documents (JSON): one row per job with common labels as columns; unreadable documents are skipped."""
    schema = """job struct<uid:string,namespace:string,name:string,outcome:string,labels:map<string,string>>, execution_started_at string, execution_finished_at string, duration_seconds double, energy struct<total_joules:double,total_kwh:double,average_power_watts:double>,
      carbon struct<emissions_gco2eq:double,energy_weighted_intensity_gco2eq_per_kwh:double>, quality struct<valid:boolean,final:boolean,energy_coverage_ratio:double,carbon_energy_coverage_ratio:double,counter_resets:int,warnings:array<string>>,
      isolation struct<clean_node:boolean,co_tenant_energy_share:double>, provenance struct<pods:array<struct<containers:array<struct<image:string,image_id:string>>>>>, workload_outputs array<struct<stdout_sha256:string>>"""
    d = documents.select(F.from_json(text, schema).alias("r")).select("r.*").filter("job.uid is not null and quality.final is not null")
    d = d if provisional else d.filter("quality.final")
    first = F.get(F.flatten(F.transform(F.coalesce("provenance.pods", F.array().cast("array<struct<containers:array<struct<image:string,image_id:string>>>>")), lambda p: p["containers"])), F.lit(0))
    sorted_labels = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("job.labels", F.create_map().cast("map<string,string>"))))))
    return d.select(
        F.col("job.uid").alias("job_uid"), "job.namespace", F.col("job.name").alias("job_name"), "job.outcome", F.col("execution_started_at").alias("started_at"), F.col("execution_finished_at").alias("finished_at"), "duration_seconds",
        F.col("energy.total_joules").alias("energy_joules"), F.col("energy.total_kwh").alias("energy_kwh"), F.col("energy.average_power_watts").alias("average_power_watts"), F.col("carbon.energy_weighted_intensity_gco2eq_per_kwh").alias("intensity"),
        F.col("carbon.emissions_gco2eq").alias("emissions_gco2eq"), "quality.valid", "quality.final", "quality.energy_coverage_ratio", "quality.carbon_energy_coverage_ratio", "quality.counter_resets", "isolation.clean_node", "isolation.co_tenant_energy_share",
        first["image"].alias("image"), first["image_id"].alias("image_id"), F.get("workload_outputs", F.lit(0))["stdout_sha256"].alias("stdout_sha256"), F.concat_ws(" | ", "quality.warnings").alias("warnings"), sorted_labels.alias("labels_json"),
        *[F.element_at("job.labels", prefix + n).alias(n) for n in labels],
    )


def exposition(latest: DataFrame, now: float, most_age: float = 5400.0) -> DataFrame:
    """Text lines of gauges from one row ``zone, t, carbon``: the intensity, its time, and whether it is fresh."""
    up = F.when(F.col("carbon").isNotNull() & (F.lit(now) - F.col("t") <= most_age), 1).otherwise(0)
    lines = F.array(
        F.lit("# TYPE carbon_intensity_gco2eq_per_kwh gauge"), F.concat(F.lit('carbon_intensity_gco2eq_per_kwh{zone="'), F.col("zone"), F.lit('"} '), F.col("carbon").cast("string")),
        F.lit("# TYPE carbon_intensity_point_timestamp_seconds gauge"), F.concat(F.lit('carbon_intensity_point_timestamp_seconds{zone="'), F.col("zone"), F.lit('"} '), F.col("t").cast("string")),
        F.lit("# TYPE carbon_intensity_up gauge"), F.concat(F.lit("carbon_intensity_up "), up.cast("string")),
    )
    return latest.select(F.explode(F.array_compact(lines)).alias("line"))


LABEL = re.compile(r"^(?:[A-Za-z0-9](?:[-A-Za-z0-9_.]{0,61}[A-Za-z0-9])?)?$")


def valid_label(value: str) -> bool:
    return bool(LABEL.match(value))


def render(template: str, values: dict[str, str]) -> str:
    """Fill ``${NAME}`` placeholders; one that is left is an error."""
    out = re.sub(r"\$\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), template)
    left = re.findall(r"\$\{(\w+)\}", out)
    if left:
        raise ValueError(f"unresolved: {', '.join(sorted(set(left)))}")
    return out


def seconds(duration: str) -> int:
    """``90``, ``15s``, ``15m``, ``2h`` or ``1d`` in seconds."""
    m = re.fullmatch(r"(\d+)([smhd]?)", duration.strip())
    if not m:
        raise ValueError(f"no duration: {duration!r}")
    return int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]
