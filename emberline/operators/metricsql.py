"""What the monitoring stack's query language computes, on long samples: ``labels MAP<STRING, STRING>, ts, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .accounting import clean_samples, reset_delta
from .asof import asof_join
from .skew import floor_div


def select(samples: DataFrame, labels: str = "labels", equal: dict[str, str] | None = None, match: dict[str, str] | None = None, unequal: dict[str, str] | None = None) -> DataFrame:
    """Label selectors =, =~ (anchored) and !=; an absent label is the empty string."""
    get = lambda k: F.coalesce(F.element_at(F.col(labels), k), F.lit(""))
    d = samples
    for k, v in (equal or {}).items():
        d = d.filter(get(k) == v)
    for k, v in (match or {}).items():
        d = d.filter(get(k).rlike(f"^(?:{v})$"))
    for k, v in (unequal or {}).items():
        d = d.filter(get(k) != v)
    return d


def by(samples: DataFrame, keys: list[str], function: str, labels: str = "labels") -> DataFrame:
    """``function by (keys)`` per instant."""
    return samples.groupBy(*[F.coalesce(F.element_at(F.col(labels), k), F.lit("")).alias(k) for k in keys], "ts").agg(getattr(F, function)("value").alias("value"))


def without(samples: DataFrame, drop: list[str], function: str, labels: str = "labels") -> DataFrame:
    """``function without (drop)``: label sets that are equal but for the dropped labels become one."""
    kept = F.array_sort(F.map_entries(F.map_filter(F.col(labels), lambda k, v: ~k.isin(drop))))
    d = samples.groupBy(kept.alias("_k"), "ts").agg(getattr(F, function)("value").alias("value"))
    return d.select(F.map_from_entries("_k").alias(labels), "ts", "value")


def increase(samples: DataFrame, keys: list[str], at: float, window: float) -> DataFrame:
    """Counter increase in (at - window, at], resets included, without extrapolation to the bounds; and its ``rate`` per second between the samples."""
    d = clean_samples(samples, keys, "value").filter((F.col("ts") > at - window) & (F.col("ts") <= at))
    d = d.withColumn("_p", F.lag("v").over(W.partitionBy(*keys).orderBy("ts")))
    g = d.groupBy(*keys).agg(F.sum(F.when(F.col("_p").isNotNull(), reset_delta(F.col("v"), F.col("_p")))).alias("increase"), (F.max("ts") - F.min("ts")).alias("_s"))
    return g.select(*keys, "increase", F.when(F.col("_s") > 0, F.col("increase") / F.col("_s")).alias("rate"))


def over_time(samples: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Per cell of ``step`` seconds: average, highest, and the sum of the cell's last value times the step (a Riemann sum's term)."""
    d = samples.filter("value is not null").withColumn("t", floor_div(F.floor("ts").cast("long"), step) * step)
    return d.groupBy(*keys, "t").agg(F.avg("value").alias("avg"), F.max("value").alias("max"), (F.max_by("value", F.struct("ts", "value")) * step).alias("term"))


def range_grid(samples: DataFrame, keys: list[str], start: int, end: int, step: int, lookback: float = 300.0) -> DataFrame:
    """Values at start, start + step, ..., end: the last sample at or before each, at most ``lookback`` seconds old; points without one are left out."""
    grid = samples.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step)))).withColumn("_row", F.xxhash64(*keys, "t"))
    j = asof_join(grid, samples, keys, "t", "ts", ["value"], lookback, "_row")
    return j.filter("matched_at is not null").select(*keys, "t", "value")


def times_scalar(vector: DataFrame, scalar: DataFrame, value: str, factor: str) -> DataFrame:
    """``vector * on() group_left() scalar``: ``scalar`` has one row."""
    return vector.join(F.broadcast(scalar.select(factor))).withColumn(value, F.col(value) * F.col(factor)).drop(factor)


def group_left(many: DataFrame, one: DataFrame, on: list[str], carry: list[str]) -> DataFrame:
    """``many * on(keys) group_left(carry) one``: carried labels of the one side on every row of the many side. Spark broadcasts the one side if it is small."""
    return many.join(one.select(*on, *carry), on)


def topk(df: DataFrame, n: int, value: str, tie: list[str], per: list[str] | None = None) -> DataFrame:
    """The n highest values (per group), ties by the given columns."""
    if not per:
        return df.orderBy(F.col(value).desc_nulls_last(), *tie).limit(n)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*per).orderBy(F.col(value).desc_nulls_last(), *tie))).filter(F.col("_n") <= n).drop("_n")


def emission_rate(watts: Column, intensity: Column) -> Column:
    """Grams per second of a power at an intensity per kWh."""
    return watts * intensity / 3.6e6


def fresh(age_s: Column, most: float = 5400.0) -> Column:
    return F.coalesce((age_s <= most).cast("int"), F.lit(0))
