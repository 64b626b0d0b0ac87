"""Problem 4: overlapping and touching intervals merged into periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .asknown import live_rows
from .skew import copied, floor_div, hot_keys, next_in_order, salted

#: Intervals are first merged within buckets of this many microseconds of their start.
BUCKET = 30 * 86_400_000_000


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us", bucket: int = BUCKET, keep: bool = False) -> DataFrame:
    """Periods ``keys, start, end`` (bigint microseconds): intervals of one key that overlap, nest or touch become one.

    Rows with a null bound or end <= start count for nothing; a null key is a key of its own. session_window with the interval's own
    length as gap merges the intervals that start in one bucket; periods that reach over bucket bounds are then joined
    through one row per bucket: the latest end so far and the start of the period that holds it. No task has to sort
    all intervals of a key. With ``keep`` the periods within buckets, which are read twice, are kept in a checkpoint.
    """
    d = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).filter("_s is not null and _e > _s").withColumn("_b", floor_div(F.col("_s"), bucket))
    gap = F.make_interval(secs=((F.col("_e") - F.col("_s")).cast("decimal(24,6)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)"))
    d = d.withColumn("_t", F.timestamp_micros("_s")).withColumn("_gap", gap)
    merged = d.groupBy(*keys, "_b", F.session_window("_t", F.col("_gap")).alias("_w")).agg(F.count("*").alias("_n"))
    merged = merged.select(*keys, "_b", F.unix_micros("_w.start").alias("_s"), F.unix_micros("_w.end").alias("_e"))
    # sessions whose bounds only meet are one to Spark 4.1; this keeps them one wherever they come out as two
    inside = W.partitionBy(*keys, "_b").orderBy("_s")
    flagged = merged.withColumn("_p", F.max("_e").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    merged = flagged.withColumn("_g", F.sum(F.when(F.col("_s") <= F.col("_p"), 0).otherwise(1)).over(inside)).groupBy(*keys, "_b", "_g").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_g")
    if keep:
        merged = checkpointed(merged)
    ordered = W.partitionBy(*keys).orderBy("_b")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    tops = merged.groupBy(*keys, "_b").agg(F.max("_e").alias("_top"), F.max_by("_s", "_e").alias("_last"))
    tops = tops.withColumn("_reach", F.max("_top").over(before)).withColumn("_own", F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last")))
    tops = tops.withColumn("_from", F.last("_own", ignorenulls=True).over(before)).select(*keys, "_b", "_reach", "_from")
    joined = merged.alias("m").join(tops.alias("t"), [F.col(f"m.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "_b"]])
    own = F.when(F.col("m._s") <= F.col("t._reach"), F.col("t._from")).otherwise(F.col("m._s"))
    periods = joined.select(*[F.col(f"m.{k}").alias(k) for k in keys], own.alias(start), F.col("m._e").alias(end))
    return periods.groupBy(*keys, start).agg(F.max(end).alias(end))


def period_gaps(periods: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us", bucket: int = BUCKET) -> DataFrame:
    """The times between successive periods of a key, as ``keys, start, end``."""
    follow = next_in_order(periods, keys, [start], bucket, [])
    return follow.filter("_next is not null").select(*keys, F.col(end).alias(start), F.col(f"_next.{start}").alias(end))


def final_rows(messages: DataFrame, least: int = 50_000) -> DataFrame:
    """The interval rows of the last version (latest publication, then highest version) of every identifier; repeated deliveries come repeatedly."""
    rows = live_rows(messages).withColumn("version", F.coalesce("version", F.lit(-1))).drop("message_id")
    last = rows.groupBy("identifier").agg(F.max(F.struct("pub", "version")).alias("_v")).select("identifier", F.col("_v.pub").alias("pub"), F.col("_v.version").alias("version"))
    key = ["identifier"]
    hot = hot_keys(rows, key, least=least)
    rows = salted(rows.withColumn("_row", F.xxhash64("valid_from", "valid_to", "mw", "unit_code")), hot, key, "_row").drop("_row")
    return rows.join(copied(last, hot, key), ["identifier", "pub", "version", "_salt"]).drop("_salt")


def outage_periods(messages: DataFrame, bucket: int = BUCKET, least: int = 50_000) -> DataFrame:
    """``unit_code, kind, start_s, end_s``: periods of finally reported unavailability of every unit, and the gaps between them.

    Rows without unit, with MW <= 0 or end <= start count for nothing; an empty table gives no rows.
    """
    rows = final_rows(messages, least).filter("status = 'ACTIVE' and mw > 0 and valid_to > valid_from and unit_code is not null")
    rows = rows.filter(~F.isnan("mw"))
    periods = checkpointed(merge_intervals(rows, ["unit_code"], "valid_from", "valid_to", bucket, keep=True))  # one row per period, read for both kinds
    gaps = period_gaps(periods, ["unit_code"], "valid_from", "valid_to", bucket)
    both = periods.withColumn("kind", F.lit("period")).unionByName(gaps.withColumn("kind", F.lit("gap")))
    return both.select("unit_code", "kind", F.expr("valid_from div 1000000").alias("start_s"), F.expr("valid_to div 1000000").alias("end_s"))
