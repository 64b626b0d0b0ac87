"""Problem 2: rows of two tables paired by nearest time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import side_by_side

#: Rows of an entity are sorted within buckets of this many microseconds.
BUCKET = 86_400_000_000


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tolerance_us: int, bucket: int = BUCKET, least: int = 50_000) -> DataFrame:
    """Each left row that has a right row of its entity at most ``tolerance_us`` away, with the nearest: ``left_id, right_id, distance_us``.

    Both tables have ``entity`` and ``t`` (bigint microseconds). Of two equally near rows the earlier counts, of right rows at one
    instant the one with the highest id; a right row at the left row's own instant has distance 0. Rows with a null entity or time match
    nothing; ids must be unique on the left. Other columns are ignored, so names cannot clash; empty tables give no rows.

    The union of both tables is sorted by entity, bucket and time; the last right row is carried forward and the next one
    backward onto left rows. Of every bucket the last and the first right row are entered in those within the tolerance too. Buckets that are
    crowded on either side are cut in time and salted, so a hot entity is sorted by many tasks and nothing is missed.
    """
    lo = left.select(F.col(left_id).alias("_l"), "entity", F.col("t").alias("_t")).dropna()
    ro = right.select(F.col(right_id).alias("_id"), "entity", F.col("t").alias("_t")).dropna().groupBy("entity", "_t").agg(F.max("_id").alias("_id"))
    ro = ro.select("entity", "_t", F.struct(F.col("_t").alias("t"), F.col("_id").alias("_r")).alias("_r"))
    lo, ro = side_by_side(lo, ro, ["entity"], bucket, tolerance_us, tolerance_us, "_l", least=least)
    keys = ["entity", "_b", "_piece"]
    both = ro.select(*keys, "_salt", F.col("_t").alias("t"), F.lit(None).cast("bigint").alias("_l"), F.col("_r").alias("_p")).unionByName(
        lo.select(*keys, "_salt", F.col("_t").alias("t"), "_l", F.lit(None).cast(ro.schema["_r"].dataType).alias("_p"))
    )
    part = W.partitionBy(*keys, "_salt")
    ahead = part.orderBy(F.col("t").asc(), F.col("_l").asc_nulls_first())  # a right row at the same instant comes first
    behind = part.orderBy(F.col("t").desc(), F.col("_l").asc_nulls_first())
    d = both.withColumn("_last", F.last("_p", ignorenulls=True).over(ahead.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_next", F.last("_p", ignorenulls=True).over(behind.rowsBetween(W.unboundedPreceding, 0))).filter("_l is not null")
    before, after = F.col("t") - F.col("_last.t"), F.col("_next.t") - F.col("t")
    pick = F.when(F.col("_next.t").isNull() | (before <= after), F.col("_last")).otherwise(F.col("_next"))
    d = d.select(F.col("_l").alias(left_id), pick.alias("_p"), "t").filter(F.abs(F.col("t") - F.col("_p.t")) <= tolerance_us)
    return d.select(left_id, F.col("_p._r").alias(right_id), F.abs(F.col("t") - F.col("_p.t")).alias("distance_us"))
