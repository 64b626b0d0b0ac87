"""Causal features. Frames are ``origin, horizon, target`` (epoch seconds) and whatever is joined; nothing later than an origin may show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .asknown import in_grid
from .asof import asof_join, version_spans
from .series import partial_sum

HOUR, DAY = 3600, 86400
TZ = "Europe/Paris"


def local(t: Column, tz: str = TZ) -> Column:
    """Local wall-clock timestamp of epoch seconds (the session's time zone is UTC)."""
    return F.from_utc_timestamp(F.timestamp_seconds(t), tz)


def local_midnight(t: Column, tz: str = TZ) -> Column:
    """Epoch seconds of the last local midnight at or before t, right on days of 23 or 25 hours too."""
    return F.unix_seconds(F.to_utc_timestamp(F.date_trunc("day", local(t, tz)), tz))


def next_midnight(t: Column, tz: str = TZ) -> Column:
    """Epoch seconds of the first local midnight after t."""
    return F.unix_seconds(F.to_utc_timestamp(F.date_add(F.to_date(local(t, tz)), 1).cast("timestamp"), tz))


def stack(origins: DataFrame, horizons: int = 24, step: int = HOUR) -> DataFrame:
    d = origins.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    return d.withColumn("target", F.col("origin") + F.col("horizon") * step)


def calendar(frame: DataFrame, tz: str = TZ) -> DataFrame:
    """Local hour, day of week (Monday 0), month, weekend, and sine and cosine of horizon, hour and day of year."""
    t = local(F.col("target"), tz)
    turn = lambda x, n: x * (2 * 3.141592653589793 / n)
    d = frame.select("*", F.hour(t).alias("hour"), F.weekday(t).alias("dow"), F.month(t).alias("month"), F.dayofyear(t).alias("_doy")).withColumn("weekend", (F.col("dow") >= 5).cast("int"))
    for name, c, n in (("horizon", "horizon", 24), ("hour", "hour", 24), ("doy", "_doy", 365.25)):
        d = d.withColumn(f"{name}_sin", F.sin(turn(F.col(c), n))).withColumn(f"{name}_cos", F.cos(turn(F.col(c), n)))
    return d.drop("_doy")


def at_target(frame: DataFrame, forecasts: DataFrame, columns: list[str], prefix: str = "fc_", tz: str = TZ) -> DataFrame:
    """Forecast columns of the target hour; those named ``day_ahead`` are null if the target lies on a later local day than the origin."""
    later = F.to_date(local(F.col("target"), tz)) > F.to_date(local(F.col("origin"), tz))
    j = frame.join(forecasts.select(F.col("t").alias("target"), *[F.col(c).alias(prefix + c) for c in columns]), "target", "left")
    mask = lambda c: F.when(~later, F.col(prefix + c)) if "day_ahead" in c else F.col(prefix + c)
    return j.select(*frame.columns, *[mask(c).alias(prefix + c) for c in columns])


def origin_state(frame: DataFrame, states: DataFrame, columns: list[str], lag: int = HOUR, prefix: str = "origin_") -> DataFrame:
    """State of the last closed hour: a row labelled t covers [t, t + 1 h), so at the origin the one at origin - 1 h is the last usable."""
    s = states.select((F.col("t") + lag).alias("origin"), *[F.col(c).alias(prefix + c) for c in columns])
    return frame.join(s, "origin", "left")


def target_lags(frame: DataFrame, states: DataFrame, columns: list[str], hours: tuple[int, ...] = (24, 168)) -> DataFrame:
    """Values at target - L hours, null unless that time lies before the origin."""
    d = frame
    for lag in hours:
        s = states.select((F.col("t") + lag * HOUR).alias("target"), *[F.col(c).alias(f"_{c}") for c in columns])
        known = F.col("target") - lag * HOUR < F.col("origin")
        d = d.join(s, "target", "left").select(*d.columns, *[F.when(known, F.col(f"_{c}")).alias(f"tgtlag{lag}_{c}") for c in columns])
    return d


def interactions(x: DataFrame, loads: list[str], winds: list[str], solar: str) -> DataFrame:
    """Wind, variable renewables, residual load and share. The load is the first listed column that exists, not the first non-null value of a row."""
    load = next((c for c in loads if c in x.columns), None)
    there = [c for c in winds if c in x.columns]
    if not there:
        return x
    d = x.withColumn("wind_mw", partial_sum(there))
    if solar not in x.columns:
        return d
    d = d.withColumn("vre_mw", F.col("wind_mw") + F.col(solar))
    if load is None:
        return d
    return d.withColumn("residual_mw", F.col(load) - F.col("vre_mw")).withColumn("vre_share", F.when(F.col(load) > 0, F.col("vre_mw") / F.col(load)))


def hybrid(x: DataFrame, load: str, own_vre: str, own_solar: str, own_wind: str, other_wind: str, other_solar: str) -> DataFrame:
    """Residual load and share by the vintaged forecast and by a mix of both sources, and how far the sources disagree."""
    share = lambda v: F.when(F.col(load) > 0, v / F.col(load))
    mixed = F.col(other_wind) + F.col(own_solar)
    return x.select(
        "*", (F.col(load) - F.col(own_vre)).alias("own_residual_mw"), share(F.col(own_vre)).alias("own_share"), mixed.alias("hybrid_vre_mw"), (F.col(load) - mixed).alias("hybrid_residual_mw"), share(mixed).alias("hybrid_share"),
        (F.col(own_solar) - F.col(other_solar)).alias("solar_gap_mw"), (F.col(own_wind) - F.col(other_wind)).alias("wind_gap_mw"),
    )


def curve_summary(frame: DataFrame, column: str) -> DataFrame:
    """Per origin mean, least, most and range over the known horizons, the step from the hour before (0 at the first), and the evening's ramp and maximum."""
    w = W.partitionBy("origin")
    c, by = F.col(column), W.partitionBy("origin").orderBy("horizon")
    before = F.when(F.row_number().over(by) == 1, c).otherwise(F.lag(column).over(by))
    evening = F.col("horizon").between(17, 21)
    ends = lambda f: f(F.when(evening, F.struct("horizon", c.alias("v")))).over(w)["v"]
    return frame.select(
        "*", (c - before).alias(f"{column}_ramp"), F.avg(column).over(w).alias(f"{column}_mean"), F.min(column).over(w).alias(f"{column}_min"), F.max(column).over(w).alias(f"{column}_max"),
        (F.max(column).over(w) - F.min(column).over(w)).alias(f"{column}_range"), (ends(F.max) - ends(F.min)).alias(f"{column}_evening_ramp"), F.max(F.when(evening, c)).over(w).alias(f"{column}_evening_max"),
    )


def multiscale(states: DataFrame, column: str, windows: tuple[int, ...] = (3, 6, 12, 24, 48, 168), keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Per hour t: level, volatility (population) and trend per hour over (t - w h, t], each null with fewer than max(2, ceil(w / 2)) values.

    The trend is the mean of the recent half minus that of the half before over half the window. The frame must be regular: the earlier half is found by
    position.
    """
    d = states
    by = W.partitionBy(*keys).orderBy("t")
    for w in windows:
        frame = by.rangeBetween(-w * HOUR + 1, 0)
        least = max(2, -(-w // 2))
        enough = F.count(column).over(frame) >= least
        old, new = w // 2, w - w // 2
        mean = lambda n: F.when(F.count(column).over(by.rangeBetween(-n * HOUR + 1, 0)) >= max(1, -(-n // 2)), F.avg(column).over(by.rangeBetween(-n * HOUR + 1, 0)))
        d = d.withColumn(f"w{w}_level", F.when(enough, F.avg(column).over(frame))).withColumn(f"w{w}_volatility", F.when(enough, F.stddev_pop(column).over(frame)))
        d = d.withColumn("_new", mean(new)).withColumn("_old", mean(old))
        d = d.withColumn(f"w{w}_trend", (F.col("_new") - F.lag("_old", new).over(by)) / max(w / 2.0, 1.0)).drop("_new", "_old")
    return d


# Fuel types of the messages and the groups they count for.
FUEL_GROUPS = {"NUCLEAR": "nuclear", "FOSSIL_GAS": "gas", "FOSSIL_HARD_COAL": "coal", "FOSSIL_OIL": "oil", "BIOMASS": "biomass"}


def fuel_group(fuel: Column) -> Column:
    """Group of a fuel type; everything beginning with HYDRO_ is hydro, unknown types have none."""
    cases = reduce(lambda a, kv: a.when(fuel == kv[0], kv[1]), FUEL_GROUPS.items(), F.when(fuel.startswith("HYDRO_"), "hydro"))
    return cases


def availability(messages: DataFrame, frame: DataFrame, groups: list[str], legacy_planned: bool = False, mode: str = "all") -> DataFrame:
    """Unavailable MW by fuel group at every target, as known at the origin, its change against the origin's own time (``*_delta_mw``), planned and
    unplanned nuclear MW, number of nuclear intervals and total.

    Of each outage the last version published by the origin counts (all its intervals), and only if ACTIVE: a cancellation hides what came before.
    Missing is 0. ``legacy_planned`` counts UNPLANNED as planned instead; ``mode`` "delta" keeps only the changes. Versions are disjoint regions in
    publication and delivery time, (origin, target) are points located in their grid: no superseded version is ever paired.
    """
    us = lambda c: F.col(c) * 1_000_000
    regions = version_spans(messages, ["identifier"], "pub", ["version"]).filter("status = 'ACTIVE' and end > start").withColumn("_group", fuel_group(F.col("fuel"))).filter(F.col("_group").isin(groups))
    regions = regions.select("identifier", "_group", "kind", "mw", us("pub").alias("pub"), us("_until").alias("superseded"), us("start").alias("valid_from"), us("end").alias("valid_to"))
    regions = checkpointed(regions)  # counted and entered in the grid: made once
    targets = frame.select("origin", F.col("horizon").cast("int").alias("horizon"), "target")
    now = frame.select("origin").distinct().select("origin", F.lit(0).alias("horizon"), F.col("origin").alias("target"))
    points = targets.unionByName(now).select("origin", "horizon", us("origin").alias("_origin"), us("target").alias("_target"))
    hit = in_grid(points, regions, [], "_target", crowded="regions")
    planned = (F.col("kind") == "PLANNED") if not legacy_planned else F.contains("kind", F.lit("PLANNED"))
    nuclear = F.col("_group") == "nuclear"
    g = hit.groupBy("origin", "horizon").agg(
        *[F.sum(F.when(F.col("_group") == x, F.col("mw"))).alias(f"{x}_mw") for x in groups], F.sum("mw").alias("total_mw"), F.sum(F.when(nuclear & planned, F.col("mw"))).alias("nuclear_planned_mw"),
        F.sum(F.when(nuclear & ~planned, F.col("mw"))).alias("nuclear_unplanned_mw"), F.sum(nuclear.cast("long")).alias("nuclear_intervals"),
    )
    names = [*(f"{x}_mw" for x in groups), "total_mw", "nuclear_planned_mw", "nuclear_unplanned_mw"]
    state = g.filter("horizon = 0").select("origin", *[F.col(f"{x}_mw").alias(f"_{x}") for x in groups])
    d = frame.join(g, ["origin", "horizon"], "left").join(state, "origin", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    changes = [(zero(f"{x}_mw") - zero(f"_{x}")).alias(f"{x}_delta_mw") for x in groups]
    if mode == "delta":
        return d.select(*frame.columns, *changes)
    return d.select(*frame.columns, *[zero(c).alias(c) for c in names], *changes, F.coalesce("nuclear_intervals", F.lit(0)).alias("nuclear_intervals"))


def outage_every_hour(messages: DataFrame, groups: list[str], tz: str = TZ) -> DataFrame:
    """Unavailable MW of every hour from the first interval's start to the last one's end, as published before the local midnight of the hour's day: per outage all
    rows of the last publication count, whatever the version.

    A row is the last known at the local midnights in (its publication, the next one], so it counts in one stretch of hours: it adds its MW at the
    first and takes them off after the last. No pair of a row and an hour is made; the running sum goes over one row per hour, in decimals.
    """
    m = messages.filter("pub is not null and start < end")
    known = version_spans(messages, ["identifier"], "pub", [], all_ties=True)
    up = lambda c: F.ceil(c / HOUR) * HOUR
    spans = known.filter("status = 'ACTIVE' and start < end").withColumn("_group", fuel_group(F.col("fuel"))).filter(F.col("_group").isin(groups))
    lo = up(F.greatest("start", next_midnight(F.col("pub"), tz)))
    hi = up(F.when(F.col("_until").isNull(), F.col("end")).otherwise(F.least(F.col("end"), next_midnight(F.col("_until"), tz))))
    mw = F.col("mw").cast("decimal(28,9)")
    steps = spans.select("_group", F.explode(F.array(F.struct(lo.alias("t"), mw.alias("x")), F.struct(hi.alias("t"), (-mw).alias("x")))).alias("_e"), lo.alias("_lo"), hi.alias("_hi")).filter("_lo < _hi").select("_group", "_e.*")
    change = steps.groupBy("t").agg(*[F.coalesce(F.sum(F.when(F.col("_group") == g, F.col("x"))), F.lit(0)).alias(g) for g in groups])
    span = m.agg(up(F.min("start")).alias("_a"), (up(F.max("end")) - HOUR).alias("_z")).filter("_a <= _z")
    hours = span.select(F.explode(F.sequence("_a", "_z", F.lit(HOUR))).alias("t"))
    w = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return hours.join(change, "t", "left").select("t", *[F.coalesce(F.sum(g).over(w), F.lit(0)).cast("double").alias(f"{g}_mw") for g in groups])


def thermal_margin(residual: DataFrame, outages: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """Residual load plus unavailable MW per group and its change over exactly 24 hours."""
    if column not in residual.columns:
        raise ValueError(f"missing residual column {column!r}")
    d = residual.join(outages, "t").select("t", *[(F.col(column) + F.col(f"{g}_mw")).alias(f"{g}_tightness") for g in groups])
    before = d.select((F.col("t") + DAY).alias("t"), *[F.col(f"{g}_tightness").alias(f"_{g}") for g in groups])
    return d.join(before, "t", "left").select("t", *[f"{g}_tightness" for g in groups], *[(F.col(f"{g}_tightness") - F.col(f"_{g}")).alias(f"{g}_delta_24h") for g in groups])


#: Seconds further back than any forecast was updated before its target.
AGES = 100 * 366 * DAY


def vintaged(vintages: DataFrame, frame: DataFrame, order: list[str]) -> DataFrame:
    """Wind and solar of the last update by the origin (and by the target): wind is null only if both kinds are, renewables need all three.

    An as-of join per kind and target: the versions of a target are sorted with the origins that look at it, not paired with them.
    """
    kinds = ("WIND_ONSHORE", "on"), ("WIND_OFFSHORE", "off"), ("SOLAR", "solar_mw")
    look = frame.select("origin", "horizon", "target", F.least("origin", "target").alias("_at"), F.explode(F.array(*[F.lit(k) for k, _ in kinds])).alias("production_type")).withColumn("_row", F.xxhash64("origin", "horizon"))
    top = asof_join(look, vintages.filter("target is not null"), ["production_type", "target"], "_at", "updated", [*[c for c in order if c != "value"], "value"], AGES, "_row")
    g = top.groupBy("origin", "horizon").agg(*[F.max(F.when(F.col("production_type") == k, F.col("value"))).alias(n) for k, n in kinds])
    g = g.withColumn("wind_mw", partial_sum(["on", "off"])).withColumn("vre_mw", F.col("on") + F.col("off") + F.col("solar_mw"))
    return frame.join(g.select("origin", "horizon", "wind_mw", "solar_mw", "vre_mw"), ["origin", "horizon"], "left")


def exchange(schedules: DataFrame, order: list[str], groups: dict[str, list[str]], tz: str = TZ) -> DataFrame:
    """Hourly net import per border group from the first version of each quarter hour, if published before the local midnight of the delivery day."""
    key = ["t", "border", "direction"]
    first = schedules.groupBy(*key).agg(F.min(F.struct("updated", *order, F.col("mw").alias("_mw"))).alias("_f"))
    d = first.select(*key, F.col("_f.updated").alias("updated"), F.col("_f._mw").alias("mw")).filter(F.col("updated") < local_midnight(F.col("t"), tz))
    h = d.groupBy(F.expr("t div 3600 * 3600").alias("t"), "border", "direction").agg(F.avg("mw").alias("mw"))
    net = h.groupBy("t", "border").agg(F.sum(F.when(F.col("direction") == "import", F.col("mw")).otherwise(-F.col("mw"))).alias("net"))
    return net.groupBy("t").agg(*[F.coalesce(F.sum(F.when(F.col("border").isin(b), F.col("net"))), F.lit(0.0)).alias(n) for n, b in groups.items()], F.sum("net").alias("total"))


def published_in_time(frame: DataFrame, value: str, updated: str, cutoff: int, tz: str = TZ) -> DataFrame:
    """The value if it was updated before the local midnight of its day or lies before the cutoff, and its change against exactly 24 hours earlier."""
    d = frame.withColumn(value, F.when((F.col(updated) < local_midnight(F.col("t"), tz)) | (F.col("t") < cutoff), F.col(value))).drop(updated)
    before = d.select((F.col("t") + DAY).alias("t"), F.col(value).alias("_b"))
    return d.join(before, "t", "left").withColumn(f"{value}_delta_24h", F.col(value) - F.col("_b")).drop("_b")


def supervised(features: DataFrame, labels: DataFrame, label: str, needed: list[str]) -> DataFrame:
    """Features with labels of the authoritative frame only; rows without label or another needed column are dropped."""
    return features.join(labels.select(F.col("t").alias("target"), label), "target", "left").dropna(subset=[label, *needed])
