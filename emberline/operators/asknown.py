"""Problem 1: event rows combined with the state that was known at their time.

Each version of an entity owns a region of the plane recorded time x valid time: from its publication to the next
one's, and the intervals it states. Regions of one entity don't overlap in recorded time, so a point (origin, target)
lies in at most one version. Regions are indexed by a grid and every point is located in its cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import clean_key, copied, floor_div, hot_keys, next_in_order, salted

DAY = 86_400_000_000
#: Cell widths of the recorded axis, finest first. A region is entered at the finest level where it covers at most SPAN + 1
#: cells, so neither short-lived nor long-lived versions cover many; a point looks at one cell of each level.
LEVELS, SPAN = (DAY // 4, 6 * DAY, 144 * DAY), 6
#: Cell width of the valid axis, and the chunk in which the versions of one entity are put in order.
VALID, CHUNK = 64 * DAY, 30 * DAY


def live_rows(messages: DataFrame) -> DataFrame:
    """Rows that aren't void, with a clean ``identifier`` and ``status`` and times in microseconds.

    Void are rows with a null in publication date, interval bounds or MW. Rows without identifier belong to no entity
    and are left out too.
    """
    return messages.select(
        clean_key("identifier").alias("identifier"), "message_id", "version", clean_key("event_status").alias("status"), "unit_code",
        F.unix_micros("publication_date").alias("pub"), F.unix_micros("interval_start").alias("valid_from"),
        F.unix_micros("interval_end").alias("valid_to"), F.col("unavailable_capacity_mw").alias("mw"),
    ).dropna(subset=["identifier", "pub", "valid_from", "valid_to", "mw"])


def version_regions(messages: DataFrame) -> DataFrame:
    """Disjoint regions of the versions: ``identifier, message_id, version, status, pub, superseded, valid_from, valid_to, mw``.

    Versions follow each other by (publication, version); two published at one instant leave the lower one an empty region,
    which is dropped. ``superseded`` is null for the last version. Repeated deliveries collapse.
    """
    rows = live_rows(messages).withColumn("version", F.coalesce("version", F.lit(-1))).drop("unit_code").distinct()
    versions = rows.groupBy("identifier", "pub", "version").agg(F.lit(1).alias("one")).drop("one")
    follow = next_in_order(versions, ["identifier"], ["pub", "version"], CHUNK, []).select("identifier", "pub", "version", F.col("_next.pub").alias("superseded"))
    regions = rows.join(follow, ["identifier", "pub", "version"])
    return regions.filter("(superseded is null or superseded > pub) and valid_to > valid_from")


def in_grid(points: DataFrame, regions: DataFrame, keys: list[str], point_id: str, least: int = 50_000, crowded: str = "points") -> DataFrame:
    """Pairs of points and the regions of their ``keys`` (may be none) that they lie in.

    ``points`` has ``_origin, _target``; ``regions`` has ``pub, superseded, valid_from, valid_to``, nulls in ``superseded`` being open. All times are bigints in
    microseconds. Regions are cut to the points' range and entered in the cells of a grid. In crowded cells the rows of the side that ``crowded`` names are
    spread over salts and the other side's copied.
    """
    horizon = points.agg(F.max("_origin").alias("_last"), F.min("_target").alias("_low"), F.max("_target").alias("_high"))
    r = regions.join(F.broadcast(horizon))  # one row that closes the open regions
    r = r.withColumn("_end", F.least(F.coalesce("superseded", F.col("_last") + 1), F.col("_last") + 1))
    r = r.withColumn("_vf", F.greatest("valid_from", "_low")).withColumn("_vt", F.least("valid_to", F.col("_high") + 1)).filter("_end > pub and _vt > _vf").drop("_last", "_low", "_high")
    level = F.lit(len(LEVELS) - 1)
    for k in range(len(LEVELS) - 2, -1, -1):
        level = F.when(F.col("_end") - F.col("pub") <= SPAN * LEVELS[k], k).otherwise(level)
    r = r.withColumn("_level", level)
    width = F.element_at(F.array(*[F.lit(w) for w in LEVELS]), F.col("_level") + 1)
    cells = lambda a, b, w: F.explode(F.sequence(floor_div(a, w), floor_div(b - 1, w)))
    r = r.withColumn("_rcell", cells(F.col("pub"), F.col("_end"), width)).withColumn("_vcell", cells(F.col("_vf"), F.col("_vt"), VALID))
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(len(LEVELS))])))
    p = p.withColumn("_rcell", floor_div(F.col("_origin"), width)).withColumn("_vcell", floor_div(F.col("_target"), VALID))
    cell = [*keys, "_level", "_rcell", "_vcell"]
    if crowded == "points":
        hot = hot_keys(p, cell, least=least)
        p, r = salted(p, hot, cell, point_id), copied(r, hot, cell)
    else:
        hot = hot_keys(r, cell, least=least)
        p, r = copied(p, hot, cell), salted(r.withColumn("_row", F.xxhash64(*regions.columns)), hot, cell, "_row").drop("_row")
    found = p.join(r, [*cell, "_salt"]).filter("_origin >= pub and _origin < _end and _target >= _vf and _target < _vt")
    return found.drop("_level", "_rcell", "_vcell", "_salt", "_end", "_vf", "_vt")


def locate(points: DataFrame, regions: DataFrame, point_id: str = "probe_id", least: int = 50_000) -> DataFrame:
    """Each point with every region it lies in: all columns of ``points``, then ``message_id, version, status, valid_from, valid_to, mw``.

    ``points`` has ``identifier`` (compared in upper case, trimmed), ``origin`` and ``target_time``. A point with a null in
    one of them, or of an unknown identifier, lies nowhere and gives no row; nor does an empty table. Extra columns of points
    are kept unless a region has one of that name.
    """
    taken = {"message_id", "version", "status", "valid_from", "valid_to", "mw", "pub", "superseded"}
    keep = [c for c in points.columns if c not in taken]
    p = points.select(*keep, clean_key("identifier").alias("_id"), F.unix_micros("origin").alias("_origin"), F.unix_micros("target_time").alias("_target")).dropna(subset=["_id", "_origin", "_target"])
    found = in_grid(p, regions.withColumnRenamed("identifier", "_id"), ["_id"], point_id, least)
    return found.select(*keep, "message_id", "version", "status", "valid_from", "valid_to", "mw")


def active_at_target(messages: DataFrame, probes: DataFrame, least: int = 50_000) -> DataFrame:
    """``probe_id, message_id`` of the probes whose version in force is ACTIVE and has an interval around the target."""
    regions = version_regions(messages).filter("status = 'ACTIVE'")  # after the regions are cut: a cancellation hides what came before
    return locate(probes.select("probe_id", "identifier", "origin", "target_time"), regions, least=least).select("probe_id", "message_id").distinct()
