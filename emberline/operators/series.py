"""Canonical frames: resampling, regular grids, de-duplication, layering, and arithmetic on the generation mix.

``t`` is epoch seconds. Null times are dropped, null values stay missing (never zero), NaN becomes null on the way in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import floor_div

# Emission factors (g/kWh) of the four emitting sources.
EMISSION = {"coal_mw": 986.0, "fuel_oil_mw": 777.0, "gas_mw": 429.0, "bioenergy_mw": 494.0}
#: The eight parts of total generation.
PARTS = ["nuclear_mw", "wind_mw", "hydro_mw", "solar_mw", "gas_mw", "bioenergy_mw", "coal_mw", "fuel_oil_mw"]
# Thresholds (MW of dispatchable gas) of the fossil regimes.
GAS_ON, GAS_PEAK = 500.0, 2500.0


def finite(column: str | Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def canonical(raw: DataFrame, mapping: dict[str, str], columns: list[str], time: str, sequence: str) -> DataFrame:
    """Rename to canonical names, add missing columns as null, read numbers leniently, keep the last row per time.

    "Last" is the highest ``sequence``. An absent time column is an error; an unreadable time drops the row.
    """
    if time not in raw.columns:
        raise ValueError(f"missing time column {time!r}")
    d = raw.withColumnsRenamed({k: v for k, v in mapping.items() if k in raw.columns and k != time})
    value = [finite(F.col(c).cast("string").try_cast("double")).alias(c) if c in d.columns else F.lit(None).cast("double").alias(c) for c in columns]
    d = d.select(F.unix_seconds(F.try_to_timestamp(F.col(time).cast("string"))).alias("t"), F.col(sequence).alias("_seq"), *value).filter("t is not null")
    return keep_last(d, ["t"], ["_seq"]).drop("_seq")


def keep_last(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row per key: the last (or first) in the total order ``order``."""
    by = [F.col(c).asc_nulls_first() if first else F.col(c).desc_nulls_last() for c in order]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def resample(df: DataFrame, keys: list[str], t: str, width: int, aggregates: dict[str, str]) -> DataFrame:
    """Aggregate onto cells of ``width`` seconds, labelled by their beginning: {column: function name}."""
    cell = (floor_div(F.col(t).cast("long"), width) * width).alias(t)
    known = df.filter(F.col(t).isNotNull())
    return known.groupBy(*keys, cell).agg(*[getattr(F, f)(finite(c)).alias(c) for c, f in aggregates.items()])


def regularize(df: DataFrame, keys: list[str], t: str, step: int) -> DataFrame:
    """Insert the missing steps between a key's first and last time, with nulls."""
    span = df.filter(F.col(t).isNotNull()).groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step))).alias(t))
    return grid.join(df, [*keys, t], "left")


def layered(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of frames in which a later frame's row replaces an earlier one's."""
    tagged = [f.withColumn("_layer", F.lit(i)) for i, f in enumerate(frames)]
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_last(d, keys, ["_layer"]).drop("_layer")


def outer_columns(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of frames with different columns."""
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), frames)


def tidy(wide: DataFrame, ids: list[str], models: list[str], horizon: str = "horizon", most: int = 24) -> DataFrame:
    """Wide predictions to one row per model, for horizons 1..most."""
    return wide.filter(F.col(horizon).between(1, most)).unpivot(ids, models, "model", "prediction")


def wide_sums(df: DataFrame, keys: list[str], pivot: str, values: list[str], measure: str) -> DataFrame:
    """One column per listed value with the measure's sum (0 where there is none), and ``total``."""
    sums = [F.coalesce(F.sum(F.when(F.col(pivot) == v, F.col(measure))), F.lit(0.0)).alias(v) for v in values]
    return df.groupBy(*keys).agg(*sums, F.sum(measure).alias("total"))


def low_carbon(parts: list[str]) -> Column:
    """Sum of the parts; null if one is missing."""
    return reduce(lambda a, b: a + b, [F.col(p) for p in parts])


def partial_sum(parts: list[str]) -> Column:
    """Sum of the parts that are there; null only if all are missing."""
    some = reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in parts])
    return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts]))


def regime(gas: Column, on: float = GAS_ON, peak: float = GAS_PEAK) -> Column:
    """0 below ``on`` MW of gas, 1 from there, 2 from ``peak`` MW on; null stays null."""
    if not 0 <= on < peak:
        raise ValueError("thresholds must be 0 <= on < peak")
    return F.when(gas >= peak, 2).when(gas >= on, 1).when(gas.isNotNull(), 0).cast("int")


def proxy_intensity(parts: list[str] = PARTS, factors: dict[str, float] = EMISSION) -> Column:
    """Intensity by emission factors over total generation, negative parts as 0; null unless all parts are there and the total is positive."""
    known = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts])
    total = reduce(lambda a, b: a + b, [F.greatest(F.col(p), F.lit(0.0)) for p in parts])
    grams = reduce(lambda a, b: a + b, [F.greatest(F.col(p), F.lit(0.0)) * f for p, f in factors.items()])
    return F.when(known & (total > 0), grams / total)


def at_times(series: DataFrame, frame: DataFrame, columns: list[str], time: str = "target") -> DataFrame:
    """``frame`` with the series' columns at ``time``: exact instants only, nulls where the series has none."""
    return frame.join(series.select(F.col("t").alias(time), *columns), time, "left").select(*frame.columns, *columns)


def with_proxy_target(frame: DataFrame, target: str) -> DataFrame:
    """The frame with its target replaced by the intensity that the emission factors give."""
    return frame.withColumn(target, proxy_intensity())


def quality_report(df: DataFrame, keys: list[str], t: str, value: str, step: int, low: float, high: float) -> DataFrame:
    """Per key: rows, missing and zero fraction, duplicate times, number of gaps, the longest gap in steps, values out of range."""
    times = df.filter(F.col(t).isNotNull())
    w = W.partitionBy(*keys).orderBy(t)
    d = times.withColumn("_gap", F.col(t) - F.lag(t).over(w))
    return d.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg(F.col(value).isNull().cast("double")).alias("missing_fraction"), F.avg(F.coalesce((F.col(value) == 0).cast("double"), F.lit(0.0))).alias("zero_fraction"),
        F.sum((F.col("_gap") == 0).cast("long")).alias("duplicate_times"), F.sum((F.col("_gap") > step).cast("long")).alias("gaps"), F.max(F.col("_gap") / step).alias("longest_gap"),
        F.sum((~F.col(value).between(low, high)).cast("long")).alias("out_of_range"),
    )
