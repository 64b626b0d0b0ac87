"""Comparison tables of experiments: captures at rest, trials, power series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series_statistics(samples: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Per series: samples, coverage of the span at the step, first, last, least, most, mean, median and 95th percentile (interpolated)."""
    d = samples.filter(F.col("value").isNotNull() & F.col("ts").isNotNull())
    expected = F.floor((F.max("ts") - F.min("ts")) / step) + 1
    return d.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.least(F.lit(1.0), F.count("*") / expected).alias("coverage"), F.min_by("value", F.struct("ts", "value")).alias("first"), F.max_by("value", F.struct("ts", "value")).alias("last"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.expr("percentile(value, 0.95)").alias("p95"),
    )


def trapezoid(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Energy of a power series by the trapezoidal rule, its span, mean, median and 95th percentile; null energy for fewer than two samples."""
    w = W.partitionBy(*keys).orderBy("ts", "value")
    d = samples.filter(F.col("value").isNotNull() & F.col("ts").isNotNull()).withColumn("_e", (F.col("value") + F.lag("value").over(w)) / 2 * (F.col("ts") - F.lag("ts").over(w)))
    return d.groupBy(*keys).agg(F.count("*").alias("samples"), F.sum("_e").alias("joules"), (F.max("ts") - F.min("ts")).alias("span"), F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.expr("percentile(value, 0.95)").alias("p95"))


def gauge_statistics(samples: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Mean, highest and final (else highest) value of the samples in each window [start, end]."""
    d = samples.join(windows.select(key, "start", "end"), key).filter("ts between start and end and value is not null")
    return d.groupBy(key).agg(F.count("*").alias("samples"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.coalesce(F.max_by("value", F.struct("ts", "value")), F.max("value")).alias("final_or_max"))


def power_series(samples: DataFrame, windows: DataFrame, key: str, zone: str = "package") -> DataFrame:
    """Samples of one zone (a null zone passes) within their window, with seconds since the first of them."""
    d = samples.filter((F.col("zone") == zone) | F.col("zone").isNull()).join(windows.select(key, "start", "end"), key).filter("ts between start and end")
    return d.withColumn("elapsed", F.col("ts") - F.min("ts").over(W.partitionBy(key))).drop("start", "end")


def idle_validity(coverage: Column, up_at_end: Column) -> Column:
    return F.coalesce((coverage >= 0.8) & up_at_end, F.lit(False))


def recommended_samples(samples: Column, target_s: float, runtime: Column) -> Column:
    """Samples for a wanted run time, rounded half to even; null for a run time of 0."""
    return F.bround(F.try_divide(samples * float(target_s), runtime), 0).cast("long")


def repeatability(trials: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Runs, mean, sample deviation and coefficient of variation (%) of each measure; deviation is null for one run."""
    agg = [F.count("*").alias("runs")]
    for m in measures:
        agg += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), (100.0 * F.try_divide(F.stddev_samp(m), F.avg(m))).alias(f"{m}_cv_pct")]
    return trials.groupBy(*keys).agg(*agg)


def idle_comparison(trials: DataFrame, idles: DataFrame, power: str, reference: str) -> DataFrame:
    """Each trial against the median of the valid idle captures: difference and difference in percent."""
    ref = idles.filter("valid").agg(F.expr(f"percentile({reference}, 0.5)").alias("idle"))
    d = trials.join(F.broadcast(ref))  # one row
    return d.withColumn("above", F.col(power) - F.col("idle")).withColumn("above_pct", 100.0 * F.try_divide(F.col(power) - F.col("idle"), F.col("idle")))


def paired_change(a: DataFrame, b: DataFrame, on: list[str], measures: list[str]) -> DataFrame:
    """Percent change of each measure from ``a`` to ``b``."""
    j = a.select(*on, *[F.col(m).alias(f"{m}_a") for m in measures]).join(b.select(*on, *[F.col(m).alias(f"{m}_b") for m in measures]), on)
    return j.select("*", *[(100.0 * F.try_divide(F.col(f"{m}_b") - F.col(f"{m}_a"), F.col(f"{m}_a"))).alias(f"{m}_change_pct") for m in measures])


def primary(summaries: DataFrame, metric: str, zone: str = "package") -> DataFrame:
    """The summaries of one metric and zone that stand for a capture; those without a zone pass."""
    return summaries.filter((F.col("metric") == metric) & ((F.col("zone") == zone) | F.col("zone").isNull()))


def metric_inventory(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and sum per label combination; nulls are groups of their own."""
    return samples.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
