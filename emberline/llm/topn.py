"""Problem 6: the top N items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """Of the rows of equal ``keys`` (nulls are equal) the one with the highest ``version``: ``keys, version, columns``.

    One aggregate per column keeps the buffers of fixed width, so the aggregation is hashed and combined before the shuffle; a null
    in a column of the highest row stays null. Rows with a null version count for nothing.
    """
    picked = [F.max_by(c, version).alias(c) for c in columns]
    return df.filter(F.col(version).isNotNull()).groupBy(*keys).agg(F.max(version).alias(version), *picked)


def top_n(df: DataFrame, groups: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every group in ``order`` (a total order), with their ``rank``.

    The rank filter lets the optimiser keep at most n rows of a group per task before the shuffle and again after it, however
    large the group. A null group is a group; groups with fewer rows come out whole; an empty table gives no rows.
    """
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= n)


def best_windows(catalog: DataFrame, n: int = 5) -> DataFrame:
    """Per (model, origin) the n cheapest candidate windows: ``model, origin, rank, catalog_id, predicted_window_cost``.

    Of a window delivered repeatedly the highest catalog_id counts, and only with a cost that is neither null nor NaN. Ties are
    broken by start time, duration and id.
    """
    rows = latest(catalog, ["model", "origin", "start_horizon", "duration_hours"], "catalog_id", ["predicted_window_cost", "window_start_time"])
    rows = rows.filter(F.col("predicted_window_cost").isNotNull() & ~F.isnan("predicted_window_cost"))
    order = ["predicted_window_cost", "window_start_time", "duration_hours", "catalog_id"]
    return top_n(rows, ["model", "origin"], order, n).select("model", "origin", "rank", "catalog_id", "predicted_window_cost")
