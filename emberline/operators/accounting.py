"""Counters, energy and carbon. ``ts`` is epoch seconds (double); samples that aren't finite are dropped, of equal times the last counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .asof import asof_join
from .series import finite
from .skew import next_in_order

#: Seconds of a counter's samples that one task puts in order.
CHUNK = 86400


def clean_samples(samples: DataFrame, keys: list[str], value: str = "joules", sequence: str | None = None) -> DataFrame:
    """Finite samples, one per time: of equal times the last by ``sequence`` (the order of delivery), without one the highest value."""
    last = F.max("v") if sequence is None else F.max_by("v", F.struct(sequence, "v"))
    d = samples.select(*keys, "ts", finite(value).alias("v"), *([sequence] if sequence else [])).dropna(subset=["ts", "v"])
    return d.groupBy(*keys, "ts").agg(last.alias("v"))


def reset_delta(cur: Column, prev: Column) -> Column:
    """Increment of a counter: after a fall the counter began anew and counts from 0, never negative."""
    return F.when(cur >= prev, cur - prev).otherwise(F.greatest(cur, F.lit(0.0)))


def pairs(clean: DataFrame, keys: list[str], extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Every clean sample with the next one of its key: ``ts, v, nts, nv``. Samples are put in order in chunks of time, so a counter that never ends is many tasks' work."""
    d = next_in_order(clean, keys, ["ts"], CHUNK, ["v"]).filter("_next is not null")
    return d.select(*keys, *extra, "ts", "v", F.col("_next.ts").alias("nts"), F.col("_next.v").alias("nv"))


def increments(samples: DataFrame, windows: DataFrame, key: str, tolerance: float = 90.0, created: bool = False, sequence: str | None = None) -> DataFrame:
    """Energy increments of every key within its window: ``key, start, end, joules, reset, window_start, window_end, first, last, note_start, note_end``.

    Anchors: the last sample at or before the start if within the tolerance; else the first after it within the tolerance (with ``created`` a
    sample (start, 0) is put in instead); else the nearest. The end likewise. Intervals over the bounds are cut in proportion to time. A window
    without a usable pair of anchors gives no rows. Anchors are one aggregated row per key; ``windows`` has one row per key.
    """
    clean = clean_samples(samples, [key], sequence=sequence)
    d = clean.join(windows.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")), key)
    before, after, late, early = (F.col("ts") <= F.col("_s")), (F.col("ts") > F.col("_s")), (F.col("ts") >= F.col("_e")), (F.col("ts") < F.col("_e"))
    pick = lambda f, cond: f(F.when(cond, F.col("ts")))
    near = lambda edge: F.min(F.struct(F.abs(F.col("ts") - F.col(edge)), F.col("ts")))["ts"]
    a = d.groupBy(key, "_s", "_e").agg(
        F.count("*").alias("_n"), pick(F.max, before).alias("_b"), pick(F.min, after).alias("_a"), pick(F.min, late).alias("_le"), pick(F.max, early).alias("_be"), near("_s").alias("_ns"), near("_e").alias("_ne")
    ).filter("_n >= 2 and _e > _s")
    by, fy = F.col("_s") - F.col("_b") <= tolerance, F.col("_a") - F.col("_s") <= tolerance
    ly, ey = F.col("_le") - F.col("_e") <= tolerance, F.col("_e") - F.col("_be") <= tolerance
    put = fy & ~F.coalesce(by, F.lit(False)) & F.lit(created)
    first = F.when(by, F.col("_b")).when(put, F.col("_s")).when(fy, F.col("_a")).otherwise(F.col("_ns"))
    last = F.when(ly, F.col("_le")).when(ey, F.col("_be")).otherwise(F.col("_ne"))
    a = a.select(
        key, "_s", "_e", first.alias("first"), last.alias("last"), F.coalesce(put, F.lit(False)).alias("_put"),
        F.when(by, F.lit(None)).when(put, "counter taken as zero at the start").when(fy, "no sample at or before the start").otherwise("start beyond tolerance").alias("note_start"),
        F.when(ly, F.lit(None)).when(ey, "no sample at or after the end").otherwise("end beyond tolerance").alias("note_end"),
    ).filter("last > first")
    of_key = ["_s", "_e", "first", "last", "note_start", "note_end"]
    used = clean.join(a, key).filter("ts between first and last").select(key, "ts", "v", *of_key)
    if created:
        used = used.unionByName(a.filter("_put").select(key, F.col("_s").alias("ts"), F.lit(0.0).alias("v"), *of_key))
    d = pairs(used, [key], of_key)
    lo, hi = F.greatest("_s", "ts"), F.least("_e", "nts")
    share = F.when(hi > lo, (hi - lo) / (F.col("nts") - F.col("ts")))
    return d.select(key, lo.alias("start"), hi.alias("end"), (reset_delta(F.col("nv"), F.col("v")) * share).alias("joules"), (F.col("nv") < F.col("v")).alias("reset"), F.col("_s").alias("window_start"), F.col("_e").alias("window_end"), "first", "last", "note_start", "note_end")


def measure(inc: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Per window ``joules, increments, resets, samples, coverage, note_start, note_end`` of its ``increments``; windows without a measurement have 0 joules and coverage."""
    covered = F.greatest(F.lit(0.0), F.least("window_end", "last") - F.greatest("window_start", "first")) / (F.col("window_end") - F.col("window_start"))
    g = inc.groupBy(key).agg(
        F.coalesce(F.sum("joules"), F.lit(0.0)).alias("joules"), F.count("joules").alias("increments"), F.sum(F.col("reset").cast("long")).alias("resets"), (F.count("*") + 1).alias("samples"), F.least(F.lit(1.0), F.max(covered)).alias("coverage"), F.max("note_start").alias("note_start"), F.max("note_end").alias("note_end")
    )
    d = windows.select(key).join(g, key, "left")
    return d.select(key, F.coalesce("joules", F.lit(0.0)).alias("joules"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("increments", "resets", "samples")], F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "note_start", "note_end")


def counter_delta(samples: DataFrame, keys: list[str], value: str = "joules", sequence: str | None = None) -> DataFrame:
    """Sum of the increments of all samples and the number of resets; null for fewer than two samples."""
    d = next_in_order(clean_samples(samples, keys, value, sequence), keys, ["ts"], CHUNK, ["v"])
    nv = F.col("_next.v")
    return d.groupBy(*keys).agg(F.sum(F.when(nv.isNotNull(), reset_delta(nv, F.col("v")))).alias("delta"), F.sum((nv < F.col("v")).cast("long")).alias("resets"), F.count("*").alias("samples"))


def enclosing_delta(samples: DataFrame, windows: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """Counter delta from the last sample at or before the start to the first at or after the end; null if either is missing."""
    clean = clean_samples(samples, [key], sequence=sequence)
    edge = clean.join(windows.select(key, "start", "end"), key).groupBy(key).agg(F.max(F.when(F.col("ts") <= F.col("start"), F.col("ts"))).alias("_a"), F.min(F.when(F.col("ts") >= F.col("end"), F.col("ts"))).alias("_z"))
    g = pairs(clean.join(edge, key).filter("ts between _a and _z").select(key, "ts", "v"), [key]).groupBy(key).agg(F.sum(reset_delta(F.col("nv"), F.col("v"))).alias("delta"))
    return windows.select(key).join(g, key, "left")


def carbon_intervals(inc: DataFrame, carbon: DataFrame, key: str, max_age: float = 2100.0, keep: bool = True) -> DataFrame:
    """Each increment with the latest intensity at or before its middle, at most ``max_age`` seconds old, and its grams; null where there is none.

    ``carbon`` has ``zone, t, carbon``; ``inc`` has the zone too. Every increment is judged on its own, whatever its order among others. ``keep`` puts the increments into a checkpoint first; without it
    they should already be cheap to read again.
    """
    points = carbon.filter(F.col("carbon") >= 0)
    if keep:
        inc = checkpointed(inc)  # the join counts its rows and sorts them: made once
    d = inc.withColumn("middle", (F.col("start") + F.col("end")) / 2).withColumn("_row", F.xxhash64(key, "start"))
    j = asof_join(d, points, ["zone"], "middle", "t", ["carbon"], max_age, "_row").drop("_row")
    return j.withColumn("grams", F.col("joules") / 3.6e6 * F.col("carbon"))


def account(inc: DataFrame, carbon: DataFrame, key: str, max_age: float = 2100.0, keep: bool = True) -> DataFrame:
    """Per key: joules, grams, energy-weighted intensity, share of the energy with an intensity, increments without one. Grams are null if no energy has one."""
    d = carbon_intervals(inc.filter("joules is not null"), carbon, key, max_age, keep)
    known = F.sum(F.when(F.col("carbon").isNotNull(), F.col("joules")))
    return d.groupBy(key).agg(
        F.sum("joules").alias("joules"), F.sum("grams").alias("grams"), F.when(known > 0, F.sum("grams") / (known / 3.6e6)).alias("intensity"), F.when(F.sum("joules") > 0, F.coalesce(known, F.lit(0.0)) / F.sum("joules")).otherwise(0.0).alias("carbon_coverage"),
        F.sum(F.col("carbon").isNull().cast("long")).alias("missing"), F.count("*").alias("intervals"),
    )


def job_report(samples: DataFrame, pods: DataFrame, carbon: DataFrame, zone: str = "FR", step: float = 10.0, max_age: float = 2100.0, sequence: str | None = None) -> DataFrame:
    """Quality-gated report per job: ``pods`` has ``job, pod, start, end``.

    Valid needs positive energy, a measured counter for every pod, 90 % of the run time and 95 % of the energy covered, and grams.
    """
    tolerance = max(90.0, 4 * step)
    inc = checkpointed(increments(samples, pods, "pod", tolerance, sequence=sequence).withColumn("zone", F.lit(zone)))  # read for the energy and for the carbon
    m = measure(inc, pods, "pod").join(pods.select("job", "pod", "start", "end"), "pod")
    energy = m.groupBy("job").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("pods"), F.sum((F.col("samples") == 0).cast("long")).alias("pods_missing"), F.sum("joules").alias("joules"), F.sum("resets").alias("resets"),
        (F.sum(F.col("coverage") * (F.col("end") - F.col("start"))) / F.sum(F.col("end") - F.col("start"))).alias("coverage"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array("note_start", "note_end")))))), " | ").alias("warnings"),
    )
    grams = account(inc.join(pods.select("pod", "job"), "pod"), carbon, "job", max_age, keep=False).select("job", "grams", "intensity", "carbon_coverage", "missing")
    d = energy.join(grams, "job", "left")
    valid = (F.col("joules") > 0) & (F.col("pods_missing") == 0) & (F.col("coverage") >= 0.9) & (F.coalesce("carbon_coverage", F.lit(0.0)) >= 0.95) & F.col("grams").isNotNull()
    return d.withColumn("watts", F.when(F.col("end") > F.col("start"), F.col("joules") / (F.col("end") - F.col("start")))).withColumn("valid", valid)


def node_energy(counters: DataFrame, jobs: DataFrame, kinds: list[str], tolerance: float = 90.0, buffer: float = 60.0, sequence: str | None = None) -> DataFrame:
    """``job, resets`` and for every kind of node counter ``<kind>_joules``, measured over the job's time; null where the node has no such counter or it can't be measured.

    ``counters`` has ``node, kind, ts, joules``; ``jobs`` has ``job, node, start, end``. A job reads the samples of its own node from ``buffer`` seconds before to after.
    """
    own = jobs.select("job", "node", "start", "end")
    near = (F.col("ts") >= F.col("start") - tolerance - buffer) & (F.col("ts") <= F.col("end") + tolerance + buffer)
    key = F.struct("job", "kind").alias("_key")
    s = counters.filter(F.col("kind").isin(kinds)).join(own, "node").filter(near).select(key, "ts", "joules", *([sequence] if sequence else []))
    w = own.select("job", "start", "end", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")).select(key, "start", "end")
    inc = increments(s, w, "_key", tolerance, sequence=sequence)
    g = inc.groupBy(F.col("_key.job").alias("job")).agg(F.sum(F.col("reset").cast("long")).alias("resets"), *[F.sum(F.when(F.col("_key.kind") == k, F.col("joules"))).alias(f"{k}_joules") for k in kinds])
    return jobs.select("job").join(g, "job", "left").withColumn("resets", F.coalesce("resets", F.lit(0)))


def node_context(jobs: DataFrame, counters: DataFrame, cpu: DataFrame, tolerance: float = 90.0, sequence: str | None = None) -> DataFrame:
    """Per job: the node's total, active and idle energy over its time, resets, mean and highest CPU ratio (cut at 1), the job's share of the active energy, and warnings.

    ``jobs`` has ``job, node, start, end, joules``; ``counters`` has ``node, kind (total, active, idle), ts, joules``; ``cpu`` has ``node, ts, ratio``. Anything missing is null.
    """
    e = node_energy(counters, jobs, ["total", "active", "idle"], tolerance, sequence=sequence)
    c = cpu.filter(F.col("ratio").isNotNull() & ~F.isnan("ratio")).join(jobs.select("job", "node", "start", "end"), "node").filter("ts between start and end").groupBy("job").agg(F.avg("ratio").alias("_m"), F.max("ratio").alias("_x"))
    d = jobs.join(e, "job", "left").join(c, "job", "left")
    share = F.when(F.col("active_joules") > 0, F.col("joules") / F.col("active_joules"))
    notes = F.array_compact(F.array(F.when(F.col("total_joules").isNull() & F.col("active_joules").isNull(), "no node counters"), F.when(share > 1, "job energy above the node's active energy")))
    cut = lambda x: F.when(F.col(x).isNotNull(), F.least(F.col(x), F.lit(1.0)))
    return d.select(*jobs.columns, "total_joules", "active_joules", "idle_joules", "resets", cut("_m").alias("cpu_mean"), cut("_x").alias("cpu_max"), share.alias("job_share"), F.array_join(notes, " | ").alias("notes"))


def isolation(job: DataFrame, pods: DataFrame, energy: DataFrame, node: DataFrame | None = None, most: float = 0.05, least_up: float = 0.99) -> DataFrame:
    """Per job: energy of other pods in its time, their share, restarts and scrape-up ratio of the node, and whether the run was clean: a known share of at most
    ``most``, no restart, and an up ratio (if known) of at least ``least_up``.

    ``energy`` has ``job, pod, joules`` of all pods seen in the job's time, null where other pods couldn't be read; those of the job itself are taken out by
    anti-join, and pods without energy don't count. ``node`` has ``job, restarts, up_ratio``, nulls where unknown.
    """
    seen = energy.groupBy("job").agg(F.max(F.col("joules").isNotNull().cast("int")).alias("_seen"))
    others = energy.join(pods.select("job", "pod"), ["job", "pod"], "left_anti").filter("joules > 0").groupBy("job").agg(F.sum("joules").alias("other_joules"), F.count("*").alias("other_pods"))
    d = job.select("job", "joules").join(seen, "job", "left").join(others, "job", "left")
    d = d.withColumn("other_joules", F.when(F.col("_seen") == 1, F.coalesce("other_joules", F.lit(0.0)))).withColumn("other_pods", F.coalesce("other_pods", F.lit(0)))
    total = F.col("joules") + F.col("other_joules")
    d = d.withColumn("share", F.when(total > 0, F.col("other_joules") / total).when(total.isNotNull(), 0.0))
    none = F.lit(None)
    d = d.join(node.select("job", "restarts", "up_ratio"), "job", "left") if node is not None else d.select("*", none.cast("bigint").alias("restarts"), none.cast("double").alias("up_ratio"))
    clean = F.coalesce(F.col("share") <= most, F.lit(False)) & (F.coalesce("restarts", F.lit(0)) == 0) & F.coalesce(F.col("up_ratio") >= least_up, F.lit(True))
    return d.withColumn("up_ratio", F.when(F.col("up_ratio").isNotNull(), F.least("up_ratio", F.lit(1.0)))).withColumn("clean", clean).drop("_seen")


def pod_lifetime(status: Column) -> Column:
    """Struct ``start, end`` from a pod status: its start time or the earliest container start; the latest end of a terminated container, null if none has ended."""
    ends = F.transform(F.concat(F.coalesce(status["containers"], F.array()), F.coalesce(status["init"], F.array())), lambda c: F.struct(c["started"].alias("s"), c["finished"].alias("f")))
    return F.struct(F.coalesce(status["start"], F.array_min(F.transform(ends, lambda c: c["s"]))).alias("start"), F.array_max(F.transform(ends, lambda c: c["f"])).alias("end"))


def job_outcome(conditions: Column, succeeded: Column) -> Column:
    """succeeded, failed or null: by a true Complete condition or a positive count, then a true Failed condition."""
    has = lambda kind: F.exists(F.coalesce(conditions, F.array().cast("array<struct<type:string,status:string>>")), lambda c: (c["type"] == kind) & (c["status"] == "True"))
    return F.when(has("Complete") | (F.coalesce(succeeded, F.lit(0)) > 0), "succeeded").when(has("Failed"), "failed")


def log_capture(logs: DataFrame, text: str, most: int = 65536) -> DataFrame:
    """SHA-256, bytes, whether cut at ``most`` bytes, and whether the text is a JSON object."""
    c = F.col(text)
    return logs.select("*", F.sha2(c, 256).alias("sha256"), F.octet_length(c).alias("bytes"), (F.octet_length(c) > most).alias("truncated"), (F.btrim(c).startswith("{") & F.expr(f"try_parse_json({text}) is not null")).alias("json_object"))


def allowed_annotations(annotations: Column, prefixes: list[str]) -> Column:
    return F.map_filter(annotations, lambda k, v: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: k.startswith(p)))
