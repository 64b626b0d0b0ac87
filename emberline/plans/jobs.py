"""Runs from files to outputs: evaluation of windows, gates over expert predictions, daily refits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exhaustive as ex
from ..operators import gate, models
from ..operators.features import target_lags
from ..session import checkpointed
from ..sources import sinks

KEYS = ["origin", "horizon", "target"]


def epoch(frame: DataFrame, column: str) -> Column:
    """Epoch seconds of a column that holds them, timestamps or ISO texts."""
    kind = dict(frame.dtypes)[column]
    if kind in ("bigint", "int"):
        return F.col(column).cast("bigint")
    return F.unix_seconds(F.col(column).cast("timestamp") if kind.startswith("timestamp") else F.try_to_timestamp(F.col(column)))


def load_predictions(spark: SparkSession, path: str, names: list[str], needed: list[str] = ["origin", "horizon"]) -> DataFrame:  # noqa: B006
    """Predictions of parquet files (one, or a folder of checkpoints): keys in epoch seconds, and ``prediction`` from the first of ``names`` that is there.

    ``target`` may also be called ``target_time``. A missing column is an error that names it. Rows written twice count once, the last file's.
    """
    d = spark.read.parquet(path)
    lacking = [c for c in needed if c not in d.columns]
    name = next((n for n in names if n in d.columns), None)
    if lacking or name is None:
        raise ValueError(f"{path} lacks {', '.join(lacking) or ' or '.join(names)}")
    target = next((epoch(d, c) for c in ("target", "target_time") if c in d.columns), epoch(d, "origin") + F.col("horizon") * 3600)
    keep = [c for c in d.columns if c not in (*KEYS, "target_time", name, "prediction")]
    d = d.select(epoch(d, "origin").alias("origin"), F.col("horizon").cast("int").alias("horizon"), target.alias("target"), F.col(name).cast("double").alias("prediction"), *keep, F.col("_metadata.file_modification_time").alias("_at"))
    from ..operators.series import keep_last

    return keep_last(d, [*(["model"] if "model" in keep else []), *KEYS], ["_at", "prediction"]).drop("_at")


def load_carbon(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``t, carbon`` of a saved series: the first of the columns ``names`` that is there."""
    from ..sources.records import snapshot

    d = snapshot(spark, path)
    name = next((n for n in names if n in d.columns), None)
    if name is None:
        raise ValueError(f"{path} has none of {', '.join(names)}")
    return d.select(F.unix_seconds(F.try_to_timestamp(F.col("timestamp").cast("string"))).alias("t"), F.col(name).cast("double").alias("carbon")).filter("t is not null").groupBy("t").agg(F.max("carbon").alias("carbon"))


def evaluate(predictions: DataFrame, primary: str, folder: str, horizon: int = 24, durations: list[int] | None = None, draws: int = 20_000) -> DataFrame:
    """All windows of all queries, decisions, tables by duration and model, and the paired comparison with its bootstrap interval, written to ``folder``.

    ``predictions`` has ``model, origin, horizon, target, prediction, actual``. Incomplete queries are an error. Returns the report: a row per model.
    """
    p = checkpointed(predictions.select("model", *KEYS, "prediction", "actual"))
    ex.assert_complete(p, horizon)
    cat = ex.catalog(p, horizon, durations)
    dec = checkpointed(ex.decisions(cat))
    pairs = ex.daily_deltas(dec, primary, horizon)
    interval = ex.block_bootstrap(pairs, ["reference"], "origin", "delta", draws=draws).drop("draws")
    compared = ex.paired(dec, primary, horizon).join(interval, "reference", "left").withColumnRenamed("reference", "model")
    report = ex.summarize(dec, ["model"]).join(compared.drop("origins"), "model", "left")
    sinks.save_windows(cat, dec, ex.aggregate(dec), report, folder)
    return report


def gates(direct: DataFrame, actual: DataFrame, published: DataFrame, physical: DataFrame | None, names: list[str], folder: str, days: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Raw gate, calibrated gates and convex blend over the direct model, yesterday's value and, if its run is complete, the physical experts (columns ``names``).

    ``direct`` has the keys and ``prediction``; ``actual`` and ``published`` have ``t, carbon``. Predictions go to ``folder`` as parquet, their metrics as CSV; returns the
    metrics.
    """
    frame = direct.select(*KEYS, F.col("prediction").alias("direct")).join(actual.select(F.col("t").alias("target"), F.col("carbon").alias("actual")), "target", "left")
    frame = target_lags(frame, published, ["carbon"], (24,)).withColumnRenamed("tgtlag24_carbon", "d1")
    experts = ["direct", "d1"]
    if physical is not None:
        frame = checkpointed(gate.include_expert(frame, physical, KEYS, names))
        first = frame.select("included").head()
        if first is not None and first["included"]:
            experts += names
    long = checkpointed(frame.unpivot([*KEYS, "actual"], experts, "expert", "value"))
    runs = {"raw": gate.raw_gate(long, experts, "direct"), "blend": gate.convex_blend(long, experts, "direct")}
    runs |= {f"calibrated_{n}d": gate.calibrated_gate(long, experts, "direct", n) for n in days}
    actuals = frame.select(*KEYS, "actual")
    out = None
    for name, d in runs.items():
        one = actuals.join(d.select("origin", "horizon", "prediction"), ["origin", "horizon"]).select(F.lit(name).alias("model"), *KEYS, "prediction", "actual")
        out = one if out is None else out.unionByName(one)
    sinks.save_snapshot(out, f"{folder}/predictions.parquet")
    metrics = gate.metrics(direct.sparkSession.read.parquet(f"{folder}/predictions.parquet"), ["model"])
    sinks.save_csv(metrics, f"{folder}/metrics.csv", ["model"])
    sinks.save_csv(gate.selection_counts(runs["raw"]), f"{folder}/selection.csv", ["block", "expert"])
    return metrics


def ridge(features: list[str], strength: float = 1.0) -> Callable[[pd.DataFrame, pd.DataFrame], pd.Series]:
    """A linear learner for refits: rows with a missing value are left out of the fit and predicted with the means."""

    def fit_predict(train: pd.DataFrame, test: pd.DataFrame) -> pd.Series:
        known = train.dropna(subset=[*features, "actual"])
        if known.empty:
            return pd.Series(np.nan, index=test.index)
        mean, scale = known[features].mean(), known[features].std(ddof=0).replace(0, 1).fillna(1)
        x = lambda d: np.column_stack([np.ones(len(d)), ((d[features].fillna(mean) - mean) / scale).to_numpy()])
        a = x(known)
        w = np.linalg.solve(a.T @ a + strength * np.diag([0.0, *[1.0] * len(features)]), a.T @ known["actual"].to_numpy())
        return pd.Series(x(test) @ w, index=test.index)

    return fit_predict


def refit(frame: DataFrame, features: list[str], folder: str, learner: Callable[[pd.DataFrame, pd.DataFrame], pd.Series] | None = None) -> int:
    """Refit for every origin that has no checkpoint in ``folder`` yet, on the whole history before it; one checkpoint for each day. Returns how many were run.

    ``frame`` has the keys, ``actual`` and the features; it is read whole, as later origins learn from earlier ones.
    """
    spark = frame.sparkSession
    due = frame.select("origin").distinct()
    if sinks.exists(spark, folder):
        due = sinks.pending_origins(due, spark.read.parquet(folder))
    due = checkpointed(due)
    n = due.count()
    if n:
        sinks.save_checkpoints(models.refit_per_origin(frame, features, learner or ridge(features), origins=due), folder)
    return n
