"""Rank scores and hysteresis windows of series ``keys, t, v`` (epoch seconds, value); missing values are no observations.

Windows are runs of successive observations: a missing hour doesn't end one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-9


def observed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def rank_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """``score``: 1 minus the share of the series at or below the value. The lowest value of n scores 1 - 1/n, not 1."""
    return observed(df).withColumn("score", 1 - F.cume_dist().over(W.partitionBy(*keys).orderBy("v")))


def rank_score_against(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """The same against another series: both are sorted together, reference rows counted up to each value."""
    d = observed(df).withColumn("_ref", F.lit(0)).unionByName(observed(reference).select(*keys, "v").withColumn("_ref", F.lit(1)), allowMissingColumns=True)
    up_to = W.partitionBy(*keys).orderBy("v").rangeBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("score", 1 - F.sum("_ref").over(up_to) / F.sum("_ref").over(W.partitionBy(*keys)))
    return d.filter("_ref = 0").drop("_ref")


def min_max_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """1 at the lowest value, 0 at the highest; 0.5 everywhere if the range is below 1e-9."""
    w = W.partitionBy(*keys)
    low, high = F.min("v").over(w), F.max("v").over(w)
    return observed(df).withColumn("score", F.when(high - low < EPS, F.lit(0.5)).otherwise(1 - (F.col("v") - low) / (high - low)))


def threshold_score(df: DataFrame, keys: list[str], quantile: float = 0.25) -> DataFrame:
    """1 at or below the exact, linearly interpolated quantile, else 0."""
    d = observed(df)
    q = d.groupBy(*keys).agg(F.expr(f"percentile(v, {quantile})").alias("_q"))
    return d.join(q, keys).withColumn("score", (F.col("v") <= F.col("_q")).cast("double")).drop("_q")


def hysteresis_runs(df: DataFrame, keys: list[str], enter: Column, leave: Column, floor: Column | None = None, ceiling: Column | None = None) -> DataFrame:
    """Observations of runs that open at v <= enter (or <= floor) and last while v <= leave (or <= floor), never above the ceiling.

    Columns of ``df`` plus ``run`` (number within the key). Between two observations that can't stay, the run begins with the first one
    that can enter.
    """
    v = F.col("v")
    always = F.lit(False) if floor is None else v <= floor
    allowed = F.lit(True) if ceiling is None else v <= ceiling
    stay, start = allowed & ((v <= F.greatest(enter, leave)) | always), allowed & ((v <= enter) | always)
    by_time = W.partitionBy(*keys).orderBy("t")
    d = observed(df).withColumn("_stay", stay).withColumn("_enter", start).withColumn("run", F.sum((~F.col("_stay")).cast("long")).over(by_time))
    within = W.partitionBy(*keys, "run").orderBy("t")
    opened = F.max((F.col("_enter") & F.col("_stay")).cast("int")).over(within)
    return d.withColumn("_open", opened).filter("_stay and _open = 1").drop("_stay", "_enter", "_open")


def run_spans(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys, "run").agg(F.min("t").alias("first"), F.max("t").alias("last")).drop("run")


def merge_spans(spans: DataFrame, keys: list[str], within: int) -> DataFrame:
    """Spans ``first, last`` of which the next begins at most ``within`` seconds after the one before ends become one."""
    w = W.partitionBy(*keys).orderBy("first")
    reach = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = spans.withColumn("_new", F.coalesce((F.col("first") - reach > within).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(w))
    return d.groupBy(*keys, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")


def best_slice(block: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Of blocks with more than ``longest`` observations only the slice of that many with the lowest mean, the earliest of equal ones."""
    w = W.partitionBy(*keys).orderBy("t")
    d = block.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    ahead = w.rowsBetween(0, longest - 1)
    mean = F.when(F.count("v").over(ahead) == longest, F.round(F.avg("v").over(ahead), 9))
    d = d.withColumn("_mean", mean)
    best = F.min(F.when(F.col("_mean").isNotNull(), F.struct("_mean", "_i"))).over(W.partitionBy(*keys))
    d = d.withColumn("_from", F.when(F.col("_n") > longest, best["_i"]).otherwise(1))
    return d.filter((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_from") + longest)).drop("_i", "_n", "_mean", "_from")


def low_carbon_windows(
    df: DataFrame, keys: list[str], enter_quantile: float = 0.25, leave_quantile: float = 0.40, enter_value: float | None = None, leave_value: float | None = None, floor: float | None = None, ceiling: float | None = None,
    step: int = 3600, merge_gap: int = 3600, shortest: int = 1, longest: int = 6, most: int = 10, reference: DataFrame | None = None,
) -> DataFrame:
    """The windows of lowest carbon per key: ``rank, start, end, hours, score, mean, confidence``.

    Thresholds are values or exact quantiles of the reference series (of the series itself by default); the one for leaving is never stricter than
    the one for entering. Runs at most ``step + merge_gap`` apart are joined with the observations between them, longer blocks cut to
    their best slice, shorter ones dropped. Score is the mean rank score, confidence half the share at or below the entering threshold and half the
    calmness relative to the reference; equal scores rank by time. A series without observations has no windows.
    """
    d = observed(df)
    ref = d if reference is None else observed(reference)
    q = ref.groupBy(*keys).agg(F.expr(f"percentile(v, {enter_quantile})").alias("_enter"), F.expr(f"percentile(v, {max(enter_quantile, leave_quantile)})").alias("_leave"), F.stddev_pop("v").alias("_spread"))
    if enter_value is not None:
        q = q.withColumn("_enter", F.lit(float(enter_value)))
    if leave_value is not None:
        q = q.withColumn("_leave", F.lit(float(leave_value)))
    scored = (rank_score(d, keys) if reference is None else rank_score_against(d, ref, keys)).join(q, keys)
    lit = lambda x: None if x is None else F.lit(float(x))
    spans = merge_spans(run_spans(hysteresis_runs(scored, keys, F.col("_enter"), F.col("_leave"), lit(floor), lit(ceiling)), keys), keys, step + merge_gap)
    # each observation belongs to at most one span: the last that begins at or before it
    marks = spans.select(*keys, F.col("first").alias("t"), F.struct("first", "last").alias("_span")).unionByName(scored.select(*keys, "t"), allowMissingColumns=True)
    current = F.last("_span", ignorenulls=True).over(W.partitionBy(*keys).orderBy("t", F.col("_span").isNull()).rowsBetween(W.unboundedPreceding, 0))
    inside = marks.withColumn("_s", current).filter("_span is null and _s is not null and t <= _s.last").select(*keys, "t", F.col("_s.first").alias("_block"))
    block = best_slice(scored.join(inside, [*keys, "t"]), [*keys, "_block"], longest)
    w = block.groupBy(*keys, "_block").agg(
        F.min("t").alias("start"), (F.max("t") + step).alias("end"), F.count("*").alias("hours"), F.avg("score").alias("score"), F.avg("v").alias("mean"),
        F.avg((F.col("v") <= F.col("_enter")).cast("double")).alias("_below"), F.stddev_pop("v").alias("_std"), F.first("_spread").alias("_ref"),
    ).filter(F.col("hours") >= shortest)
    calm = 1 - F.least(F.col("_std") / (F.col("_ref") + EPS), F.lit(1.0))
    w = w.withColumn("confidence", F.least(F.greatest(0.5 * F.col("_below") + 0.5 * calm, F.lit(0.0)), F.lit(1.0)))
    w = w.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "start")))
    return w.filter(F.col("rank") <= most).select(*keys, "rank", "start", "end", "hours", "score", "mean", "confidence")


def reasons(windows: DataFrame) -> DataFrame:
    """The windows with ``reasons``: what speaks for each, in words."""
    said = F.array(
        F.format_string("mean of %.1f g/kWh over %d h", F.col("mean"), F.col("hours")), F.format_string("lower than %.0f %% of the hours on average", 100 * F.col("score")),
        F.when(F.col("confidence") >= 0.5, "mostly below the entering threshold and calm").otherwise("partly above the entering threshold or unsteady"),
    )
    return windows.withColumn("reasons", said)


def hour_iou(a: DataFrame, b: DataFrame, step: int = 3600) -> DataFrame:
    """One row ``iou, common, either`` of the hours covered by two sets of windows ``start, end``; 1.0 if both are empty."""
    hours = lambda w: w.select(F.explode(F.sequence("start", F.col("end") - step, F.lit(step))).alias("t")).distinct()
    d = hours(a).withColumn("_a", F.lit(1)).join(hours(b).withColumn("_b", F.lit(1)), "t", "full_outer")
    both = F.coalesce(F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)), F.lit(0))
    r = d.agg(both.alias("common"), F.count("*").alias("either"))
    return r.select(F.when(F.col("either") == 0, F.lit(1.0)).otherwise(F.col("common") / F.greatest("either", F.lit(1))).alias("iou"), "common", "either")
