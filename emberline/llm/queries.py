"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import clean_key
from . import mixing, nearest, packing, spam, tokens, topn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "energy_intervals").select("interval_id", clean_key("area_code").alias("entity"), F.unix_micros("interval_start").alias("t"))
    value = F.col("carbon_intensity_gco2_kwh")
    points = table(spark, sf_dir, "carbon_points").filter((clean_key("basis") == "PRODUCTION") & (value >= 0) & (value < float("inf")))
    right = points.select("point_id", clean_key("area_code").alias("entity"), F.unix_micros("point_ts").alias("t"))
    return nearest.nearest_join(left, right, "interval_id", "point_id", 2_100_000_000)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("interval_id", "point_id")


def p2_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far away the partners lie, by minute."""
    return _nearest(spark, sf_dir).groupBy(F.expr("distance_us div 60000000").alias("minutes")).agg(F.count("*").alias("n"), F.max("distance_us").alias("farthest_us"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_windows(table(spark, sf_dir, "window_catalog")).select("catalog_id")


def p6_best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_windows(table(spark, sf_dir, "window_catalog")).withColumn("origin", F.unix_micros("origin"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.sized(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, table(spark, sf_dir, "container_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, mixing.Fit, DataFrame]:
    documents = tokens.sized(table(spark, sf_dir, "documents"), "source", "repo", "author_email", "lang", "text")
    targets = table(spark, sf_dir, "mix_targets")
    return *mixing.mixture(documents, targets), targets


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _, _ = _mixture(spark, sf_dir)
    return mixed.select("doc_id", "label", "tokens", F.round("rate", 9).alias("rate"), "cap", "uses")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(*_mixture(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filler, abnormality and linked sites of every document."""
    d = spam.scored(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.round("filler", 4).alias("filler"), F.round("deviation", 3).alias("deviation"), "sites")


QUERIES = {"p2_found": p2_found, "p2_distances": p2_distances, "p6_found": p6_found, "p6_best_windows": p6_best_windows, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores}

_NEAREST = """
pts as (
  select upper(trim(area_code)) as area, epoch_us(point_ts) as t, max(point_id) as point_id from carbon_points
  where upper(trim(basis)) = 'PRODUCTION' and isfinite(carbon_intensity_gco2_kwh) and carbon_intensity_gco2_kwh >= 0 and area_code is not null and point_ts is not null
  group by 1, 2),
ivs as (select interval_id, upper(trim(area_code)) as area, epoch_us(interval_start) as t from energy_intervals where area_code is not null and interval_start is not null),
sides as (
  select i.interval_id, p.point_id, i.t - p.t as d, p.t as pt from ivs i asof join pts p on i.area = p.area and i.t >= p.t
  union all select i.interval_id, p.point_id, p.t - i.t as d, p.t from ivs i asof join pts p on i.area = p.area and i.t <= p.t),
pairs as (
  select interval_id, point_id, d from (select *, row_number() over (partition by interval_id order by d, pt) as rn from sides where d <= 2100000000) where rn = 1)
"""

_BEST = """
best as (
  select * from (
    select *, row_number() over (partition by model, origin order by predicted_window_cost, window_start_time, duration_hours, catalog_id) as rank from (
      select *, row_number() over (partition by model, origin, start_horizon, duration_hours order by catalog_id desc) as v from window_catalog)
    where v = 1 and predicted_window_cost is not null and not isnan(predicted_window_cost))
  where rank <= 5)
"""

ORACLE = {
    "p2_found": f"with {_NEAREST} select interval_id, point_id from pairs",
    "p2_distances": f"with {_NEAREST} select d // 60000000 as minutes, count(*) as n, max(d) as farthest_us from pairs group by 1",
    "p6_found": f"with {_BEST} select catalog_id from best",
    "p6_best_windows": f"with {_BEST} select model, epoch_us(origin) as origin, rank::int as rank, catalog_id, predicted_window_cost from best",
}
