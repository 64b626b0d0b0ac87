"""Problem 5: irregular readings onto a regular grid.

Readings of every source of a capture are put on cells [c, c + w). Between successive readings a counter's increment (after
resets) is shared out over the cells in proportion to the overlap, a gauge is taken as a straight line; stretches longer than
``MAX_GAP`` seconds, and those before the first and after the last reading, stay uncovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import floor_div

#: Microseconds of time that one task sorts at a time, and the longest gap that is filled. Readings closer than MAX_GAP to a
#: chunk's bounds are also given to the neighbour, so that all stretches that are filled are seen by both.
CHUNK, MAX_GAP = 6 * 3_600_000_000, 900_000_000
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def finite_number(text: Column) -> Column:
    """The finite number that a text states, or null: NaN, infinities, empty and other texts have none."""
    value = F.when(text.rlike(NUMBER), F.btrim(text, F.lit(" \t\r\n")).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def instant_us(text: Column) -> Column:
    """Microseconds of an ISO 8601 instant with up to nine decimals and any UTC offset; null if it is none or lies before 1900."""
    short = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"(\.[0-9]{1,6})[0-9]*", "$1")
    us = F.unix_micros(F.try_to_timestamp(short))
    return F.when(us > -2_208_988_800_000_000, us)


def series_readings(samples: DataFrame) -> DataFrame:
    """``capture_id, source_id, ts, value, counter``: one row per row of the metric matrix; ``value`` is null where it has no finite number."""
    return samples.select(
        "capture_id", F.col("series_id").alias("source_id"), F.unix_micros("sample_ts").alias("ts"), finite_number(F.col("sample_value")).alias("value"),
        F.coalesce(F.col("metric_name").endswith("_total"), F.lit(False)).alias("counter"),
    )


def target_readings(polls: DataFrame) -> DataFrame:
    """As ``series_readings`` for polls of targets: a reading is a scrape of a poll with health up, its value the scrape's duration."""
    up = F.lower(F.btrim("health", F.lit(" \t\r\n"))) == "up"
    return polls.select(
        "capture_id", F.col("target_id").alias("source_id"), F.when(up, instant_us(F.col("last_scrape"))).alias("ts"),
        F.coalesce("last_scrape_duration_s", F.lit(0.0)).alias("value"), F.lit(False).alias("counter"),
    )


def regular_grid(readings: DataFrame, captures: DataFrame, width_s: Column | int, max_gap: int = MAX_GAP, chunk: int = CHUNK) -> DataFrame:
    """One row per capture, source and grid cell that reaches into the capture.

    Columns: ``capture_id, source_id, cell_s, readings, covered_s, amount, value, missing``. ``readings`` counts the distinct instants
    with a usable reading in the cell, ``missing`` is true where there are none; ``covered_s`` are the seconds between successive
    readings, ``amount`` a counter's increment in them and ``value`` a gauge's mean over them, or a single reading's value (null if
    uncovered). Of readings at one instant the highest value counts. A source whose readings are all unusable has all its cells
    missing; captures without rows and rows without capture or source give no cells; a reading without instant is no reading.
    """
    runs = captures.select("capture_id", F.unix_micros("started_at").alias("_from"), F.unix_micros("ended_at").alias("_to"), (F.lit(width_s) if isinstance(width_s, int) else width_s).cast("long").alias("_w"))
    runs = runs.filter("_w > 0 and _to > _from")
    named = readings.filter("capture_id is not null and source_id is not null")
    sources = named.groupBy("capture_id", "source_id").agg(F.bool_or("counter").alias("_counter")).join(runs, "capture_id")
    us = F.col("_w") * 1_000_000
    first, end = floor_div(F.col("_from"), us) * us, F.col("_to")
    spec = sources.withColumn("_c0", first).withColumn("_chunk", F.explode(F.sequence(floor_div(F.col("_c0"), chunk), floor_div(end - 1, chunk))))
    # a chunk owns the cells that begin in it
    lo = floor_div(F.greatest(F.col("_c0"), F.col("_chunk") * chunk) + us - 1, us) * F.col("_w")
    hi = floor_div(F.least(end, (F.col("_chunk") + 1) * chunk) - 1, us) * F.col("_w")
    spec = spec.withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi >= _lo")
    spec = spec.select("capture_id", "source_id", "_chunk", F.lit(None).cast("long").alias("ts"), F.lit(None).cast("double").alias("value"), F.struct("_w", "_lo", "_hi", "_counter").alias("_spec"))
    r = named.filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    own = floor_div(F.col("ts"), chunk)
    near = F.array_distinct(F.array(own, floor_div(F.col("ts") - max_gap, chunk), floor_div(F.col("ts") + max_gap, chunk)))
    r = r.select("capture_id", "source_id", F.explode(near).alias("_chunk"), "ts", "value", F.lit(None).cast(spec.schema["_spec"].dataType).alias("_spec"))
    by = W.partitionBy("capture_id", "source_id", "_chunk").orderBy(F.col("ts").asc_nulls_first(), F.col("value").desc_nulls_last())
    d = spec.unionByName(r)
    d = d.select("capture_id", "source_id", "_chunk", "ts", "value", F.lag("ts").over(by).alias("_pt"), F.last("_spec", ignorenulls=True).over(by).alias("_s"), F.col("_spec").isNotNull().alias("_is_spec"))
    d = d.filter(F.col("_s").isNotNull() & (F.col("_is_spec") | F.col("_pt").isNull() | (F.col("ts") > F.col("_pt"))))
    d = d.withColumn("_pt", F.lag("ts").over(by)).withColumn("_pv", F.lag("value").over(by))  # of the readings that count: the same sort
    w, us = F.col("_s._w"), F.col("_s._w") * 1_000_000
    joined = F.col("_pt").isNotNull() & (F.col("ts") - F.col("_pt") <= max_gap)
    from_cell = F.greatest(floor_div(F.when(joined, F.col("_pt")).otherwise(F.col("ts")), us) * w, F.col("_s._lo"))
    to_cell = F.least(floor_div(F.col("ts"), us) * w, F.col("_s._hi"))
    empty = F.array().cast("array<bigint>")
    cells = F.when(F.col("_is_spec"), F.sequence("_s._lo", "_s._hi", w)).when(from_cell <= to_cell, F.sequence(from_cell, to_cell, w)).otherwise(empty)
    rise = F.when(F.col("value") >= F.col("_pv"), F.col("value") - F.col("_pv")).otherwise(F.greatest(F.col("value"), F.lit(0.0)))
    d = d.select("capture_id", "source_id", "_chunk", "ts", "value", "_pt", "_pv", "_is_spec", joined.alias("_joined"), w.alias("_w"), F.col("_s._counter").alias("_counter"), F.explode(cells).alias("cell_s"))
    a, b = F.greatest(F.col("_pt"), F.col("cell_s") * 1_000_000), F.least(F.col("ts"), (F.col("cell_s") + F.col("_w")) * 1_000_000)
    span = F.when(~F.col("_is_spec") & F.col("_joined"), (b - a) / 1e6)
    at = lambda x: F.col("_pv") + (F.col("value") - F.col("_pv")) * ((x - F.col("_pt")) / (F.col("ts") - F.col("_pt")))
    here = ~F.col("_is_spec") & F.col("ts").between(F.col("cell_s") * 1_000_000, (F.col("cell_s") + F.col("_w")) * 1_000_000 - 1)
    d = d.select(
        "capture_id", "source_id", "_chunk", "cell_s", "_counter", here.cast("long").alias("_here"), span.alias("_span"), F.when(here, F.col("value")).alias("_value"),
        F.when(span.isNotNull(), F.when(F.col("_counter"), rise * (b - a) / (F.col("ts") - F.col("_pt"))).otherwise((at(a) + at(b)) / 2 * (b - a) / 1e6)).alias("_amount"),
    )
    cell = d.groupBy("capture_id", "source_id", "_chunk", "cell_s").agg(
        F.sum("_here").alias("readings"), F.coalesce(F.sum("_span"), F.lit(0.0)).alias("covered_s"), F.sum("_amount").alias("_amount"), F.avg("_value").alias("_mean"), F.bool_or("_counter").alias("_counter")
    )
    gauge = F.when(F.col("covered_s") > 0, F.col("_amount") / F.col("covered_s")).otherwise(F.col("_mean"))
    return cell.select(
        "capture_id", "source_id", "cell_s", "readings", "covered_s", F.when(F.col("_counter"), F.col("_amount")).alias("amount"),
        F.when(~F.col("_counter"), gauge).alias("value"), (F.col("readings") == 0).alias("missing"),
    )


def capture_grid(samples: DataFrame, polls: DataFrame, captures: DataFrame, target_width_s: int = 60) -> DataFrame:
    """The grids of all series (cells of the capture's nominal step) and of all targets (cells of ``target_width_s``)."""
    series = regular_grid(series_readings(samples), captures, F.col("step_s"))
    return series.unionByName(regular_grid(target_readings(polls), captures, target_width_s))
