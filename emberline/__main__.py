"""python -m emberline windows | account | summarize | observe | import | evaluate | gate | refit: the library on files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Windows of lowest carbon of the last hours of a snapshot ``timestamp, <column>``; the reference is the whole snapshot only if asked for."""
    from .config import load, window_parameters
    from .operators.lowcarbon import low_carbon_windows
    from .sources.records import snapshot

    d = snapshot(spark, a.input)
    s = d.select(F.lit(a.zone).alias("zone"), F.unix_seconds(F.try_to_timestamp(F.col("timestamp").cast("string"))).alias("t"), F.col(a.column).cast("double").alias("v"))
    end = a.at or s.agg(F.max("t")).first()[0] or 0
    part = s.filter((F.col("t") > end - a.horizon * 3600) & (F.col("t") <= end))
    config = load(a.config) if a.config else {}
    overrides = {"enter_quantile": a.percentile, "leave_quantile": a.percentile} if a.percentile else {}
    return low_carbon_windows(part, ["zone"], reference=s if a.historical else None, **window_parameters(config, **overrides))


def account(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Reports of jobs from parquet: samples ``pod, ts, joules``, pods ``job, pod, start, end``, carbon ``zone, t, carbon``."""
    from .operators.accounting import job_report

    return job_report(spark.read.parquet(a.samples), spark.read.parquet(a.pods), spark.read.parquet(a.carbon), a.zone)


def summarize(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .sources.sinks import summarize_reports

    d = spark.read.option("wholetext", True).text(f"{a.input}/*.json")
    return summarize_reports(d, a.labels.split(",") if a.labels else [], a.prefix, provisional=a.provisional)


def observe(spark: SparkSession, a: argparse.Namespace) -> None:
    """Follow a folder of finished pods and append final reports."""
    from .operators.accounting import job_report
    from .streaming.live import observe as follow

    pods = spark.readStream.schema("job string, pod string, start double, end double").parquet(a.pods)
    build = lambda b: job_report(spark.read.parquet(a.samples), b, spark.read.parquet(a.carbon), a.zone).withColumnsRenamed({"job": "job_uid", "end": "finished_at"}).withColumn("final", F.col("valid"))
    follow(pods, build, a.output, a.checkpoint).awaitTermination()


def fetch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .sources.records import CANONICAL, REALTIME_ONLY
    from .sources.remote import register

    register(spark)
    fields = [f for f in CANONICAL if a.realtime or f not in REALTIME_ONLY]
    r = spark.read.format("emberline_records").option("start", a.start).option("end", a.end).option("chunk", "days:30" if a.realtime else "year")
    return r.option("base_url", a.base_url).option("dataset", a.dataset).option("fields", ",".join(fields)).option("populated", "taux_co2").load()


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """All windows of the models' predictions, decisions and comparison, to a folder."""
    from .plans import jobs

    p = jobs.load_predictions(spark, a.predictions, a.names.split(","), ["model", "origin", "horizon", "actual"])
    jobs.evaluate(p, a.primary, a.output, a.horizon, draws=a.draws).show(truncate=False)


def gate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Gates over direct and physical predictions, to a folder."""
    from .plans import jobs

    names, columns = a.experts.split(","), a.columns.split(",")
    physical = jobs.load_predictions(spark, a.physical, names) if a.physical else None
    if physical is not None:
        physical = physical.withColumnRenamed("prediction", names[0])
    live = jobs.load_carbon(spark, a.carbon, columns)
    jobs.gates(jobs.load_predictions(spark, a.direct, a.names.split(",")), live, live, physical, names, a.output).show(truncate=False)


def refit(spark: SparkSession, a: argparse.Namespace) -> None:
    """Refit for every origin without a checkpoint, a day's file each."""
    from .plans import jobs

    print(jobs.refit(spark.read.parquet(a.frame), a.features.split(","), a.output))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="emberline")
    sub = p.add_subparsers(dest="command", required=True)
    commands = {}

    def command(f, **arguments):
        name = {"fetch": "import"}.get(f.__name__, f.__name__)
        c = sub.add_parser(name, help=f.__doc__)
        for key, options in arguments.items():
            c.add_argument("--" + key.replace("_", "-"), **options)
        c.add_argument("--output", default="")
        commands[name] = f

    need, flag = {"required": True}, {"action": "store_true"}
    command(windows, input=need, column={"default": "carbon_intensity_gco2_kwh"}, horizon={"type": int, "default": 24}, at={"type": int, "default": 0}, percentile={"type": float, "default": 0.0}, config={"default": ""}, zone={"default": "FR"}, historical=flag)
    command(account, samples=need, pods=need, carbon=need, zone={"default": "FR"})
    command(summarize, input=need, labels={"default": ""}, prefix={"default": ""}, provisional=flag)
    command(observe, pods=need, samples=need, carbon=need, checkpoint=need, zone={"default": "FR"})
    command(fetch, base_url=need, dataset=need, start={"type": int, "required": True}, end={"type": int, "required": True}, realtime=flag)
    names = {"default": "prediction,prediction_raw,direct"}
    command(evaluate, predictions=need, primary=need, names=names, horizon={"type": int, "default": 24}, draws={"type": int, "default": 20_000})
    command(gate, direct=need, carbon=need, physical={"default": ""}, experts={"default": "physical"}, names=names, columns={"default": "carbon_intensity_gco2_kwh,carbon"})
    command(refit, frame=need, features=need)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = commands[a.command](spark, a)
    if out is None:
        return
    if a.output.endswith(".csv"):
        from .sources.sinks import save_csv

        save_csv(out, a.output)
    elif a.output:
        out.write.mode("overwrite").parquet(a.output)
    else:
        out.show(100, truncate=False)


if __name__ == "__main__":
    main()
