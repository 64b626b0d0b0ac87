"""Live forms of the batch operators. On the same data each ends at the batch result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.skew import floor_div


def hourly_means(stream: DataFrame, keys: list[str], time: str, value: str, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Tumbling means by event time; later data than ``late`` is dropped once its window has been given out."""
    d = stream.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w")).agg(F.avg(value).alias(value), F.count("*").alias("n"))
    return d.select(*keys, F.unix_seconds("w.start").alias("t"), value, "n")


def sliding_sums(stream: DataFrame, keys: list[str], time: str, value: str, width: str, slide: str, late: str = "2 hours") -> DataFrame:
    d = stream.withWatermark(time, late).groupBy(*keys, F.window(time, width, slide).alias("w")).agg(F.sum(value).alias(value))
    return d.select(*keys, F.unix_seconds("w.start").alias("t"), value)


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str = "2 hours") -> DataFrame:
    d = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return d.select(*keys, F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n")


def latest_state(stream: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The last version per key so far (update mode); history is kept in the source, never overwritten."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("s")).select(*keys, "s.*")


def emission_rates(stream: DataFrame, width: int = 15, most_age: float = 5400.0) -> DataFrame:
    """Power times the latest intensity, per zone and cell of ``width`` seconds.

    ``stream`` has ``zone, ts`` (epoch seconds), ``kind`` (power or carbon) and ``value``, both kinds in one stream. The state of a zone is its last
    intensity; power without a fresh one gives a null rate. Within a batch rows are taken in time order, the intensity of an instant first;
    files or triggers must bring time forward.
    """
    cells = stream.withColumn("cell", floor_div(F.floor("ts").cast("long"), width) * width)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, level = state.get if state.exists else (float("nan"), float("nan"))
        rows = pd.concat(list(batches)).sort_values(["ts", "kind", "value"], kind="stable")
        carbon = (rows["kind"] == "carbon").to_numpy()
        since = rows["ts"].where(carbon).ffill().fillna(at)
        known = rows["value"].where(carbon).ffill().fillna(level)
        if carbon.any() or state.exists:
            state.update((float(since.iloc[-1]), float(known.iloc[-1])))
        p = rows[~carbon]
        rate = (p["value"] * known[~carbon] / 3.6e6).where(p["ts"] - since[~carbon] <= most_age)
        yield pd.DataFrame({"zone": key[0], "t": p["cell"].astype("int64"), "watts": p["value"].astype(float), "rate": rate})

    return cells.groupBy("zone").applyInPandasWithState(step, "zone string, t bigint, watts double, rate double", "at double, level double", "append", "NoTimeout")


def hysteresis(stream: DataFrame, enter: float, leave: float) -> DataFrame:
    """Low-carbon runs per zone as they close: the state is the open run. Rows ``zone, t, v`` must come in time order across batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(batches)).dropna(subset=["v"]).sort_values("t")
        for t, v in zip(rows["t"], rows["v"]):
            if v <= max(enter, leave) and (first is not None or v <= enter):
                first, last = (int(t) if first is None else first), int(t)
            elif first is not None:
                out.append((key[0], first, last))
                first = last = None
        if first is not None:
            state.update((first, last))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["zone", "first", "last"])

    return stream.groupBy("zone").applyInPandasWithState(step, "zone string, first bigint, last bigint", "first bigint, last bigint", "append", "NoTimeout")


#: Hours after which a job whose report can't become final is given up.
GIVE_UP_HOURS = 168


def report_status(jobs: DataFrame, now: float) -> DataFrame:
    """``final``, ``provisional`` or ``given_up`` per job: final once valid, given up when it ended more than GIVE_UP_HOURS ago."""
    old = F.lit(now) - F.col("end") > GIVE_UP_HOURS * 3600
    return jobs.withColumn("status", F.when(F.col("valid"), "final").when(old, "given_up").otherwise("provisional")).withColumn("final", F.col("valid"))


def report_states(stream: DataFrame, late: str = "0 seconds", give_up_hours: float = GIVE_UP_HOURS) -> DataFrame:
    """Reports that become final when their labels arrive, or are given up: rows ``job, status, finished``.

    ``stream`` has ``job, finished`` (epoch seconds), ``seen`` (timestamp of the observation: event time) and ``valid``. A job is provisional with the first observation
    that isn't valid, final with the first that is; a job without a final report is given up when event time passes its end by ``give_up_hours``, by a
    timer. Final jobs are remembered until then, so none is reported twice.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, finished = state.get if state.exists else ("", 0.0)
        out = []
        if state.hasTimedOut:
            if status == "provisional":
                out.append((key[0], "given_up", finished))
            state.remove()
        else:
            rows = pd.concat(list(batches))
            finished = max(finished, float(rows["finished"].max()))
            after = "final" if status == "final" or bool(rows["valid"].any()) else "provisional"
            if after != status:
                out.append((key[0], after, finished))
            state.update((after, finished))
            state.setTimeoutTimestamp(int(max((finished + give_up_hours * 3600) * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(out, columns=["job", "status", "finished"])

    return stream.withWatermark("seen", late).groupBy("job").applyInPandasWithState(step, "job string, status string, finished double", "status string, finished double", "append", "EventTimeTimeout")


def origins_due(after: int, now: int, step: int = 86_400) -> list[int]:
    """The daily origins (00:00 UTC) after the last one done, up to now: what a trigger has to run."""
    return list(range((after // step + 1) * step, now + 1, step))


def observe(jobs: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Report every finished job of a stream: each batch builds its reports and appends those that have no final document yet.

    Labels that arrive late only make a report provisional; the job is built again when its stream brings it again. A restart repeats at
    most one batch, which the sink makes harmless.
    """
    from ..sources.sinks import save_reports

    def write(batch: DataFrame, epoch: int) -> None:
        save_reports(build(batch), folder)

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LiveCarbon:
    """The series for now: near real time for spans that begin in the last 30 days, else history; what was loaded is kept for ``ttl`` seconds."""

    def __init__(self, realtime: Callable[[], DataFrame], history: Callable[[int, int], DataFrame], ttl: float = 300.0, clock: Callable[[], float] | None = None):
        import time

        self.realtime, self.history, self.ttl, self.clock = realtime, history, ttl, clock or time.time
        self.kept: DataFrame | None = None
        self.at = float("-inf")

    def load(self, start: int, end: int) -> DataFrame:
        """Rows with start <= t <= end."""
        now = self.clock()
        if start < now - 30 * 86_400:
            d = self.history(start, end)
        else:
            if self.kept is None or now - self.at > self.ttl:
                self.kept, self.at = self.realtime(), now
            d = self.kept
        return d.filter((F.col("t") >= start) & (F.col("t") <= end))


def drained(result: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream to the end of its input and return what it wrote: appended rows, or with ``complete`` the last whole result."""
    spark: SparkSession = result.sparkSession

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    q = result.writeStream.outputMode(mode).foreachBatch(replace if mode == "complete" else append).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(result.schema).parquet(f"{folder}/out")
    return out.select(*result.columns)
