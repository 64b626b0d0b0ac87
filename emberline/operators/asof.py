"""As-of, version and interval joins on epoch seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import floor_div, next_in_order, side_by_side


def asof_join(left: DataFrame, right: DataFrame, by: list[str], lt: str, rt: str, carry: list[str], tolerance: float, row_id: str, least: int = 50_000) -> DataFrame:
    """``left`` with the ``carry`` columns of the last right row of its keys at or before ``lt``, at most ``tolerance`` seconds old, else nulls.

    Of right rows at one instant the one with the highest carried values counts. Both sides are sorted together within cells of time, each cell with the
    last right row of those before it; crowded cells are cut in time and salted, whichever side crowds them, so a hot key is many tasks' work. Left
    rows without key or time keep nulls and are sorted by nobody. ``row_id`` identifies a left row.
    """
    none = F.lit(None)
    known = F.col(lt).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    ro = right.dropna(subset=[rt, *by]).select(*by, F.col(rt).cast("double").alias("_t"), F.struct(F.col(rt).alias("_at"), *carry).alias("_r")).groupBy(*by, "_t").agg(F.max("_r").alias("_r"))
    lo = left.filter(known).withColumn("_t", F.col(lt).cast("double"))
    lo, ro = side_by_side(lo, ro, by, int(max(1, -(-4 * tolerance // 1))), tolerance, 0, row_id, least=least)
    both = lo.withColumn("_left", F.lit(True)).unionByName(ro, allowMissingColumns=True)
    w = W.partitionBy(*by, "_b", "_piece", "_salt").orderBy("_t", F.col("_left").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    d = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_left")
    fits = F.col(lt) - F.col("_m._at") <= tolerance
    d = d.select(*left.columns, F.when(fits, F.col("_m._at")).alias("matched_at"), *[F.when(fits, F.col(f"_m.{c}")).alias(c) for c in carry])
    kinds = {f.name: f.dataType for f in d.schema}
    rest = left.filter(~known).select(*left.columns, *[none.cast(kinds[c]).alias(c) for c in ("matched_at", *carry)])
    return d.unionByName(rest)


#: Seconds in which the versions of one key are put in order at a time.
CHUNK = 30 * 86400


def latest_versions(facts: DataFrame, points: DataFrame, key: list[str], point: str, published: str, order: list[str], strict: bool = False, all_ties: bool = False) -> DataFrame:
    """Facts as they were known at each point: of every key the last version published by it.

    ``points`` (a small set of distinct instants, e.g. forecast origins) multiplies the facts, so each fact is first given the stretch
    [published, next published) in which it is the last of its key, and joined to the points in it by cells of time; no pair of a point and a
    superseded fact is ever made. ``all_ties`` keeps all rows that share the last publication instant, else ``order`` decides. Facts without
    publication are never known.
    """
    return stab(version_spans(facts, key, published, order, all_ties), points, published, "_until", point, open_start=strict).drop("_until")


def version_spans(facts: DataFrame, key: list[str], published: str, order: list[str], all_ties: bool = False) -> DataFrame:
    """Facts with ``_until``: when the next version of their key was published (null for the last); of those published at one instant only the
    highest in ``order`` stay unless ``all_ties``. The versions of a key are put in order in chunks of time."""
    d = facts.filter(F.col(published).isNotNull())
    keyed = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*key, published]]
    heads = d.groupBy(*key, published).agg(F.max(F.struct(*order)).alias("_top")) if order else d.select(*key, published).distinct()
    spans = next_in_order(heads, key, [published], CHUNK, []).withColumn("_until", F.col(f"_next.{published}")).drop("_next")
    d = d.alias("f").join(spans.alias("s"), keyed).select("f.*", "_until", *(["_top"] if order else []))
    if order and not all_ties:
        d = d.filter(F.struct(*order).eqNullSafe(F.col("_top")))
    return d.drop("_top")


#: Cell widths of ``stab``, finest first. An interval is entered at the finest level where it covers at most SPAN + 1 cells, a point looks at one
#: cell of each level.
LEVELS, SPAN = (21_600, 518_400, 12_441_600), 6


#: Salts over which the intervals of every cell are spread; the points are copied for each.
SALTS = 16


def stab(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, open_start: bool = False) -> DataFrame:
    """Pairs of intervals [start, end) (or (start, end] if ``open_start``) and points in them; a null end is open.

    Intervals are cut to the points' range and entered in at most SPAN + 1 cells (more only above the widest level), so neither short nor long ones
    cost a row per point. The intervals of a cell are spread over salts and the points, which are few, copied: no cell is one task's work, and the
    intervals need not be counted first.
    """
    span = points.agg(F.min(point).alias("_lo"), F.max(point).alias("_hi"))
    d = intervals.join(F.broadcast(span))  # one row
    lo, hi = F.greatest(F.col(start), F.col("_lo")), F.least(F.coalesce(F.col(end), F.col("_hi") + 1), F.col("_hi") + 1)
    d = d.withColumn("_a", lo).withColumn("_z", hi).filter("_z >= _a and _hi is not null")
    level = F.lit(len(LEVELS) - 1)
    for k in range(len(LEVELS) - 2, -1, -1):
        level = F.when(F.col("_z") - F.col("_a") <= SPAN * LEVELS[k], k).otherwise(level)
    width = F.element_at(F.array(*[F.lit(w) for w in LEVELS]), F.col("_level") + 1)
    d = d.withColumn("_level", level)
    d = d.withColumn("_cell", F.explode(F.sequence(floor_div(F.col("_a"), width), floor_div(F.col("_z"), width)))).drop("_a", "_z", "_lo", "_hi")
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(len(LEVELS))]))).withColumn("_cell", floor_div(F.col(point), width))
    d = d.withColumn("_salt", F.pmod(F.xxhash64(*intervals.columns), F.lit(SALTS)).cast("int"))
    j = d.join(p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_level", "_cell", "_salt"])
    inside = (F.col(point) > F.col(start)) & (F.col(end).isNull() | (F.col(point) <= F.col(end))) if open_start else (F.col(point) >= F.col(start)) & (F.col(end).isNull() | (F.col(point) < F.col(end)))
    return j.filter(inside).drop("_level", "_cell", "_salt")
