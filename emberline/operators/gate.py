"""Causal choice, calibration and blending of experts, and forecast metrics.

The long frame is ``origin, horizon, target, actual, expert, value``. History of an origin and block: rows of earlier origins with the target before the
origin and at most L days back, of the same block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .asof import stab

DAY = 86400
# The blocks of horizons.
BLOCKS = ((1, 7), (8, 15), (16, 21), (22, 24))


def block(horizon: Column) -> Column:
    c = F.lit(None).cast("int")
    for i, (a, b) in enumerate(BLOCKS):
        c = F.when(horizon.between(a, b), i).otherwise(c)
    return c


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``missing, extra``: keys of a that b lacks and the reverse, duplicates included. Both 0 means that b may join."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).agg(F.count("*").alias("missing")).join(F.broadcast(right.exceptAll(left).agg(F.count("*").alias("extra"))))


def physical_variants(frame: DataFrame, base: str, total: str, bio: tuple[str, str], oil: tuple[str, str]) -> DataFrame:
    """The base with bioenergy, then also oil, put at yesterday's value instead of the predicted one (pairs of yesterday, predicted); never below 0."""
    change = lambda pair, factor: factor * (F.coalesce(F.col(pair[0]), F.col(pair[1])) - F.col(pair[1])) / F.col(total)
    one = F.col(base) + change(bio, 494.0)
    return frame.select("*", F.greatest(one, F.lit(0.0)).alias("with_bio"), F.greatest(one + change(oil, 777.0), F.lit(0.0)).alias("with_bio_oil"))


def history(long: DataFrame, days: int) -> DataFrame:
    """Each history row with every origin it counts for (``at``): found by day cells, so a row meets the origins of its L days only."""
    h = long.withColumn("block", block(F.col("horizon"))).withColumn("_open", F.greatest("origin", "target")).withColumn("_close", F.col("target") + days * DAY)
    points = long.select(F.col("origin").alias("at")).distinct()
    return stab(h.filter("_close > _open"), points, "_open", "_close", "at", open_start=True).drop("_open", "_close")


def ape(scale: Column | float = 1.0) -> Column:
    return F.when(F.col("actual") > 0, F.abs(F.col("value") * scale - F.col("actual")) / F.col("actual"))


def choose(long: DataFrame, scores: DataFrame, order: list[str], fallback: str) -> DataFrame:
    """Per (origin, block) the eligible expert with the lowest score, ties by the experts' order; ``fallback`` if none is.

    ``scores`` has ``at, block, expert, mape, n`` (and may have ``scale``). Eligible is an expert with history whose values of the block are all there.
    """
    pos = F.array_position(F.array(*[F.lit(e) for e in order]), F.col("expert"))
    now = long.withColumn("block", block(F.col("horizon"))).groupBy(F.col("origin").alias("at"), "block", "expert").agg(F.min(F.col("value").isNotNull().cast("int")).alias("_all"))
    keys = now.select("at", "block").distinct()
    extra = [c for c in scores.columns if c not in ("at", "block", "expert")]
    best = now.filter("_all = 1").join(scores.filter("n > 0"), ["at", "block", "expert"]).withColumn("_k", F.row_number().over(W.partitionBy("at", "block").orderBy(F.round("mape", 9), pos))).filter("_k = 1").select("at", "block", "expert", *extra)
    return keys.join(best, ["at", "block"], "left").withColumn("expert", F.coalesce("expert", F.lit(fallback)))


def apply_choice(long: DataFrame, chosen: DataFrame, fallback: str, scale: str | None = None) -> DataFrame:
    """The chosen expert's value of every row, the fallback's where it is missing."""
    d = long.withColumn("block", block(F.col("horizon")))
    v = d.join(chosen.withColumnsRenamed({"at": "origin"}), ["origin", "block", "expert"])
    fb = d.filter(F.col("expert") == fallback).select("origin", "horizon", F.col("value").alias("_fb"))
    factor = F.lit(1.0) if scale is None else F.coalesce(F.col(scale), F.lit(1.0))
    return v.join(fb, ["origin", "horizon"], "left").withColumn("prediction", F.coalesce(F.col("value") * factor, F.col("_fb"))).drop("_fb", "value")


def raw_gate(long: DataFrame, order: list[str], fallback: str, days: int = 14) -> DataFrame:
    long = checkpointed(long)  # history, current values and fallback all read it
    s = history(long, days).groupBy("at", "block", "expert").agg((100.0 * F.avg(ape())).alias("mape"), F.count(ape()).alias("n"))
    return apply_choice(long, choose(long, s, order, fallback), fallback)


def best_scale(h: DataFrame, keys: list[str], low: int = 75, high: int = 125, floor_actual: bool = False) -> DataFrame:
    """Per key the scale low/100 ... high/100 with the lowest mean error relative to the actual, the first of equal ones: ``raw, n``. One mean for each scale, no copies of rows."""
    base = F.greatest(F.abs("actual"), F.lit(1e-9)) if floor_actual else F.col("actual")
    usable = h.filter(F.col("value").isNotNull() & F.col("actual").isNotNull() & (F.lit(floor_actual) | (F.col("actual") > 0)))
    losses = [F.avg(F.abs(F.col("value") * (F.lit(s) / 100.0) - F.col("actual")) / base).alias(f"_l{s}") for s in range(low, high + 1)]
    g = usable.groupBy(*keys).agg(F.count("*").alias("n"), *losses)
    best = F.array_min(F.array(*[F.struct(F.round(f"_l{s}", 12).alias("l"), F.lit(s).alias("s")) for s in range(low, high + 1)]))
    return g.select(*keys, (best["s"] / 100.0).alias("raw"), "n")


def calibrated_gate(long: DataFrame, order: list[str], fallback: str, days: int, shrink: float = 0.5, least: float = 0.8, most: float = 1.2) -> DataFrame:
    """Each expert scaled by its recent best scale, shrunk towards 1 and bounded, then the gate on the scaled errors."""
    long = checkpointed(long)
    h = checkpointed(history(long, days))  # for the scales and for the scaled errors
    s = best_scale(h, ["at", "block", "expert"]).withColumn("scale", F.least(F.greatest(1 + shrink * (F.col("raw") - 1), F.lit(least)), F.lit(most)))
    m = h.join(s.select("at", "block", "expert", "scale"), ["at", "block", "expert"]).groupBy("at", "block", "expert").agg((100.0 * F.avg(ape(F.col("scale")))).alias("mape"), F.count(ape()).alias("n"), F.max("scale").alias("scale"))
    return apply_choice(long, choose(long, m, order, fallback), fallback, "scale")


def convex_blend(long: DataFrame, order: list[str], fallback: str, days: int = 14, resolution: int = 20) -> DataFrame:
    """Best mixture of one or two experts per (origin, block) on a grid of 1/resolution, with a slight pull to the fallback.

    Candidates number n + C(n, 2) (resolution - 1) for n experts; their weights are a constant array of the plan. Experts with a missing value in
    the block take no part; history rows must have all experts that do. Without history the fallback has weight 1.
    """
    n = len(order)
    grid = [[float(i == j) for j in range(n)] for i in range(n)]
    for a in range(n):
        for b in range(a + 1, n):
            grid += [[u / resolution if j == a else 1 - u / resolution if j == b else 0.0 for j in range(n)] for u in range(1, resolution)]
    values = lambda d, keys: d.groupBy(*keys).agg(*[F.max(F.when(F.col("expert") == e, F.col("value"))).alias(f"v{i}") for i, e in enumerate(order)], F.max("actual").alias("actual"))
    long = checkpointed(long)
    now = values(long.withColumn("block", block(F.col("horizon"))), ["origin", "block", "horizon"])
    there = now.groupBy("origin", "block").agg(*[F.min(F.col(f"v{i}").isNotNull().cast("int")).alias(f"a{i}") for i in range(n)])
    h = values(history(long, days), ["at", "block", "origin", "horizon"]).withColumnRenamed("origin", "_o").withColumnRenamed("at", "origin").join(there, ["origin", "block"])
    full = F.col("actual") > 0
    for i in range(n):
        full = full & ((F.col(f"a{i}") == 0) | F.col(f"v{i}").isNotNull())
    mixture = lambda g: sum((F.coalesce(F.col(f"v{i}"), F.lit(0.0)) * x for i, x in enumerate(g) if x), F.lit(0.0))
    losses = [F.avg(F.abs(mixture(g) - F.col("actual")) / F.col("actual")).alias(f"_l{k}") for k, g in enumerate(grid)]
    g = h.filter(full).groupBy("origin", "block", *[f"a{i}" for i in range(n)]).agg(F.count("*").alias("n"), *losses)
    fall = order.index(fallback)

    def candidate(k: int) -> Column:
        allowed = F.lit(True)
        for i, x in enumerate(grid[k]):
            if x:
                allowed = allowed & (F.col(f"a{i}") == 1)
        return F.when(allowed, F.struct(F.round(f"_l{k}", 11).alias("l"), F.lit(1e-12 * (1 - grid[k][fall])).alias("pull"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("loss")))

    weights = F.array(*[F.array(*[F.lit(x) for x in g]) for g in grid])
    best = g.withColumn("_b", F.array_min(F.array_compact(F.array(*[candidate(k) for k in range(len(grid))])))).filter("_b is not null")
    best = best.select("origin", "block", (100.0 * F.col("_b.loss")).alias("score"), "n", F.get(weights, F.col("_b.k")).alias("w"))
    d = now.join(best, ["origin", "block"], "left")
    alone = F.array(*[F.lit(float(e == fallback)) for e in order])
    d = d.withColumn("w", F.coalesce("w", alone)).withColumn("n", F.coalesce("n", F.lit(0)))
    out = F.lit(0.0)
    for i in range(n):
        out = out + F.when(F.col("w")[i] > 0, F.col("w")[i] * F.col(f"v{i}")).otherwise(0.0)
    return d.select("origin", "block", "horizon", "actual", out.alias("prediction"), "score", "n", *[F.col("w")[i].alias(f"weight_{e}") for i, e in enumerate(order)])


def mean_weights(blend: DataFrame, order: list[str]) -> DataFrame:
    """Mean blend weights per block, each origin's taken once (at the block's first horizon): ``block, origins, weight_*``."""
    first = blend.groupBy("block", "origin").agg(F.min("horizon").alias("horizon"))
    d = blend.join(first, ["block", "origin", "horizon"])
    return d.groupBy("block").agg(F.count("*").alias("origins"), *[F.avg(f"weight_{e}").alias(f"weight_{e}") for e in order])


def include_expert(frame: DataFrame, expert: DataFrame, keys: list[str], columns: list[str], complete_only: bool = True) -> DataFrame:
    """``frame`` with the expert's ``columns`` and ``included``: the expert joins as a whole or, if its keys aren't exactly those of the frame (each once),
    not at all (nulls); without ``complete_only`` whatever rows it has. An unfinished run must not change the set of experts midway."""
    lacking = key_differences(frame, expert, keys)  # one row
    ok = lacking.select((((F.col("missing") == 0) & (F.col("extra") == 0)) | F.lit(not complete_only)).alias("included"))
    d = frame.join(F.broadcast(ok)).join(expert.select(*keys, *columns), keys, "left")
    return d.select(*frame.columns, *[F.when(F.col("included"), F.col(c)).alias(c) for c in columns], "included")


def selection_counts(gated: DataFrame) -> DataFrame:
    return gated.select("origin", "block", "expert").distinct().groupBy("block", "expert").agg(F.count("*").alias("n"))


def recent_scale(prior: DataFrame, stable: float = 0.93, weight: float = 0.75, days: int = 14) -> DataFrame:
    """Per origin the scale of the last days' raw predictions and stable + weight * (recent - stable); the stable one without history."""
    h = history(prior.withColumn("expert", F.lit("raw")), days).filter(F.col("origin") >= F.col("at") - days * DAY)
    s = best_scale(h, ["at"], 70, 130, floor_actual=True)
    d = prior.select(F.col("origin").alias("at")).distinct().join(s, "at", "left")
    raw = F.coalesce("raw", F.lit(stable))
    return d.select(F.col("at").alias("origin"), raw.alias("recent"), (stable + weight * (raw - stable)).alias("scale"), F.coalesce("n", F.lit(0)).alias("n"))


def metrics(frame: DataFrame, keys: list[str], signed: bool = False) -> DataFrame:
    """MAPE, WAPE, MAE, RMSE, bias, means and rows. By default over finite rows with a positive actual; ``signed`` keeps all and divides by the actual's size."""
    e = F.col("prediction") - F.col("actual")
    d = frame.filter(F.col("prediction").isNotNull() & F.col("actual").isNotNull() & (F.lit(signed) | (F.col("actual") > 0))).withColumn("_e", e)
    return (d.groupBy(*keys) if keys else d.groupBy()).agg(*_metric_columns())


def _metric_columns() -> list[Column]:
    e, a = F.col("_e"), F.abs("actual")
    return [
        (100.0 * F.avg(F.abs(e) / a)).alias("mape"), (100.0 * F.sum(F.abs(e)) / F.sum(a)).alias("wape"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg("actual").alias("mean_actual"), F.avg("prediction").alias("mean_prediction"), F.count("*").alias("n"),
    ]


def metrics_by_sets(frame: DataFrame, sets: list[str]) -> DataFrame:
    """The metrics overall and by each listed column: grouping sets, one pass over the data."""
    d = frame.filter("prediction is not null and actual > 0").withColumn("_e", F.col("prediction") - F.col("actual"))
    g = d.groupingSets([[], *[[F.col(s)] for s in sets]], *[F.col(s) for s in sets])
    return g.agg(F.grouping_id().alias("level"), *_metric_columns())


def paired_errors(frame: DataFrame, candidate: str, reference: str) -> DataFrame:
    """Mean absolute percentage error of two models by origin: ``origin, candidate, reference, delta``, and from it the share of days better."""
    d = frame.filter("actual > 0").withColumn("_p", 100.0 * F.abs(F.col("prediction") - F.col("actual")) / F.col("actual"))
    # one row for each origin
    g = d.groupBy("origin").agg(F.avg(F.when(F.col("model") == candidate, F.col("_p"))).alias("candidate"), F.avg(F.when(F.col("model") == reference, F.col("_p"))).alias("reference"))
    return g.withColumn("delta", F.col("candidate") - F.col("reference"))


def paired_summary(paired: DataFrame) -> DataFrame:
    """Mean difference of the errors and the percentage of origins on which the candidate is better: one row."""
    d = paired.filter("delta is not null")
    return d.agg(F.avg("delta").alias("mean_delta"), (100.0 * F.avg((F.col("delta") < 0).cast("double"))).alias("better_pct"), F.count("*").alias("origins"))
