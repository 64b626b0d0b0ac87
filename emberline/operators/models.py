"""Learners: regime mixtures of experts with Spark ML, the physical head as column arithmetic, and refits per origin."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import EMISSION


def mix_experts(probabilities: list[Column], experts: list[Column]) -> Column:
    total = F.lit(0.0)
    for p, e in zip(probabilities, experts):
        total = total + p * e
    return total


def sharpened(probabilities: list[Column], alpha: float) -> list[Column]:
    """p ** alpha, normalised (by at least 1e-12)."""
    powers = [F.pow(p, F.lit(alpha)) for p in probabilities]
    total = F.greatest(sum(powers[1:], powers[0]), F.lit(1e-12))
    return [p / total for p in powers]


def hard(probabilities: list[Column]) -> list[Column]:
    """1 for the first of the highest, 0 for the others."""
    top = F.greatest(*probabilities)
    out, taken = [], F.lit(False)
    for p in probabilities:
        out.append(F.when(~taken & (p == top), 1.0).otherwise(0.0))
        taken = taken | (p == top)
    return out


def physical_head(gas: Column, coal: Column, oil: Column, bio: Column, total: Column) -> tuple[Column, Column]:
    """Intensity of predicted parts over max(total, sum of the emitting parts, 1), and that denominator; parts are taken as at least 0."""
    g, c, o, b = (F.greatest(x, F.lit(0.0)) for x in (gas, coal, oil, bio))
    denominator = F.greatest(total, g + c + o + b, F.lit(1.0))
    grams = EMISSION["gas_mw"] * g + EMISSION["coal_mw"] * c + EMISSION["fuel_oil_mw"] * o + EMISSION["bioenergy_mw"] * b
    return F.greatest(grams / denominator, F.lit(0.0)), denominator


def gate_variant(base: Column, gas: Column, base_gas: Column, denominator: Column) -> Column:
    return F.greatest(base + EMISSION["gas_mw"] * (gas - base_gas) / denominator, F.lit(0.0))


def side_by_side(fits: list[Callable]) -> list:
    """Results of the fits, which run at once: each is a long chain of small jobs."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml import classification, regression  # noqa: F401  threads must not import them at once

    with ThreadPoolExecutor(len(fits)) as pool:
        return [x.result() for x in [pool.submit(f) for f in fits]]


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def fit_regime_experts(train: DataFrame, features: list[str], label: str, regime: str, floor: float = 8.0, trees: int = 20, seed: int = 42, weight: str | None = None, step: float = 0.1, classes: int | None = None, least: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """A three-class forest with balanced weights and one boosted regressor per regime with absolute loss, weighted by 1 / max(label, floor).

    ``weight`` names a column to weight by instead, ``classes`` is the forest's number of trees if it isn't ``trees``, and no expert's value is
    taken as less than ``least``. The experts are fitted side by side. Returns a function that adds ``p0, p1, p2, e0, e1, e2`` and ``prediction`` = sum of p * e, at least 0. A regime without training rows uses all
    rows. Missing features must be filled before.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    counts = {r[regime]: r["count"] for r in train.groupBy(regime).count().collect()}  # at most three rows
    n = sum(counts.values())
    balance = F.lit(1.0)
    for k, c in counts.items():
        balance = F.when(F.col(regime) == k, n / (len(counts) * c)).otherwise(balance)
    t = _vector(train, features).withColumn("_cw", balance).withColumn("_rw", F.col(weight) if weight else 1.0 / F.greatest(F.col(label), F.lit(floor))).withColumn("_y", F.col(regime).cast("double"))
    clf = RandomForestClassifier(labelCol="_y", featuresCol="features", weightCol="_cw", numTrees=classes or trees, maxDepth=6, seed=seed, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_class").fit(t)

    def expert(k: int):
        part = t.filter(F.col(regime) == k) if counts.get(k, 0) >= 2 else t
        return GBTRegressor(labelCol=label, featuresCol="features", weightCol="_rw", lossType="absolute", maxIter=trees, maxDepth=4, stepSize=step, seed=seed, predictionCol=f"e{k}").fit(part)

    regs = side_by_side([lambda k=k: expert(k) for k in range(3)])

    def predict(df: DataFrame) -> DataFrame:
        d = clf.transform(_vector(df, features))
        prob = vector_to_array("_prob")
        d = d.withColumn("_pa", prob)
        for k in range(3):
            d = d.withColumn(f"p{k}", F.coalesce(F.get("_pa", F.lit(k)), F.lit(0.0)))
            d = regs[k].transform(d)
            if least is not None:
                d = d.withColumn(f"e{k}", F.greatest(f"e{k}", F.lit(least)))
        d = d.withColumn("prediction", F.greatest(mix_experts([F.col(f"p{k}") for k in range(3)], [F.col(f"e{k}") for k in range(3)]), F.lit(0.0)))
        return d.drop("features", "_raw", "_prob", "_class", "_pa")

    return predict


def fit_regressor(train: DataFrame, features: list[str], label: str, name: str, trees: int = 20, seed: int = 42, weight: str | None = None, step: float = 0.1):
    from pyspark.ml.regression import GBTRegressor

    m = GBTRegressor(labelCol=label, featuresCol="features", lossType="absolute", maxIter=trees, maxDepth=4, stepSize=step, seed=seed, predictionCol=name, **({"weightCol": weight} if weight else {})).fit(_vector(train, features))
    return lambda df: m.transform(_vector(df, features)).drop("features")


def recency_weight(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life)


def fit_physical_experts(
    train: DataFrame, features: list[str], regime: str, actual: str, time: str, floor: float = 12.0, half_life: float | None = None, warm_coal: tuple[str, str] | None = None, pooled_gas: bool = False, trees: int = 300, classes: int = 250, step: float = 0.035, seed: int = 42
) -> Callable[[DataFrame], DataFrame]:
    """Gas by regime, pooled coal, oil, biomass and total generation, and the fixed formula over them.

    Every regressor is weighted by 1 / max(``actual``, ``floor``), with ``half_life`` (days) also by recency to the newest ``time`` (epoch seconds) of
    ``train``, which has the parts and ``total_generation_mw``. ``warm_coal`` names the columns of the coal a day before and of the month: the former
    is the coal of February to October where known. Returns a function that adds ``hat_*`` of the parts, ``prediction`` and ``denominator``, and
    with ``pooled_gas`` also ``hat_pooled_gas_mw, prediction_pooled``. Rows without a label or regime are left out.
    """
    parts = ["coal_mw", "fuel_oil_mw", "bioenergy_mw", "total_generation_mw"]
    known = train.dropna(subset=[regime, actual, time, "gas_mw", *parts])
    weight = 1.0 / F.greatest(F.col(actual), F.lit(floor))
    if half_life is not None:
        newest = known.agg(F.max(time)).first()[0]
        weight = weight * recency_weight((F.lit(newest) - F.col(time)) / 86400.0, half_life)
    t = known.withColumn("_w", weight).coalesce(8).cache()  # one row per hour
    try:
        pooled = [*parts, *(["gas_mw"] if pooled_gas else [])]
        name = lambda c: "hat_pooled_gas_mw" if c == "gas_mw" else f"hat_{c}"
        gas, *others = side_by_side([
            lambda: fit_regime_experts(t, features, "gas_mw", regime, floor, trees, seed, "_w", step, classes, 0.0),
            *(lambda c=c: fit_regressor(t, features, c, name(c), trees, seed, "_w", step) for c in pooled),
        ])
    finally:
        t.unpersist()

    def predict(df: DataFrame) -> DataFrame:
        d = gas(df).withColumnRenamed("prediction", "hat_gas_mw")
        for f in others:
            d = f(d)
        for c in pooled:
            d = d.withColumn(name(c), F.greatest(name(c), F.lit(0.0)))
        if warm_coal:
            before, month = map(F.col, warm_coal)
            d = d.withColumn("hat_coal_mw", F.when(month.between(2, 10) & before.isNotNull() & ~F.isnan(before), F.greatest(before, F.lit(0.0))).otherwise(F.col("hat_coal_mw")))
        head = lambda g: physical_head(F.col(g), *(F.col(f"hat_{c}") for c in parts))
        p, den = head("hat_gas_mw")
        d = d.withColumn("prediction", p).withColumn("denominator", den)
        return d.withColumn("prediction_pooled", head("hat_pooled_gas_mw")[0]) if pooled_gas else d

    return predict


def refit_per_origin(frame: DataFrame, features: list[str], fit_predict: Callable[[pd.DataFrame, pd.DataFrame], pd.Series], window_days: int | None = None, expected: int = 24, origins: DataFrame | None = None) -> DataFrame:
    """``origin, horizon, prediction`` of a learner refitted for every origin on all rows with target < origin.

    ``frame`` has ``origin, horizon, target, actual`` and the features. Each origin is one group: its rows and the whole history before it, found
    by day cells; ``window_days`` leaves rows out that are older. An origin that hasn't exactly ``expected`` rows is an error. With ``origins``
    only these are refitted.
    """
    from .asof import stab

    h = frame.withColumn("_open", F.greatest("origin", "target")).withColumn("_close", F.col("target") + window_days * 86400 if window_days else F.lit(None).cast("bigint"))
    run = (frame if origins is None else origins).select(F.col("origin").alias("at")).distinct()
    train = stab(h, run, "_open", "_close", "at", open_start=True).drop("_open", "_close").withColumn("_train", F.lit(True))
    both = train.unionByName(frame.withColumn("at", F.col("origin")).join(run, "at", "left_semi").select(*frame.columns, "at", F.lit(False).alias("_train")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t, e = pdf[pdf["_train"]], pdf[~pdf["_train"]]
        if len(e) != expected:
            raise ValueError(f"origin {pdf['at'].iloc[0]} has {len(e)} targets, expected {expected}")
        p = fit_predict(t, e) if len(t) else pd.Series([None] * len(e), index=e.index, dtype="float64")
        return pd.DataFrame({"origin": e["origin"], "horizon": e["horizon"], "prediction": p})

    return both.groupBy("at").applyInPandas(one, "origin bigint, horizon int, prediction double")
