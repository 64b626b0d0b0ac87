"""Problem 3: readings that a source cannot really have had.

One hidden Markov model per source with the states normal, spike, stuck and out-of-range. What a source normally does is learned
from all its captures: the range of its sustained operation and the noise at both ends of it (gauges), its highest sustained
rate (counters), and how often two successive readings are equal. A first forward-backward pass over all readings gives the expected number of every
transition and how far normal readings stray beyond the range, summed per source; with them the model is estimated anew, and a second pass and hard bounds set the flags.

Readings are cut into chunks of time per source and capture, sorted once by Spark and handed on as arrays; a hot source or capture is
thus spread over many tasks, and per source only a row of statistics is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .skew import copied, floor_div, hot_keys, salted

HOUR = 3_600_000_000
#: A chunk's length, and how much of the neighbours' readings it sees around its own.
CHUNK, MARGIN = 24 * HOUR, HOUR // 2
NORMAL, SPIKE, STUCK, OUTSIDE = range(4)
#: Where the estimation starts from. An excursion is normal with a normal density of WIDE noise widths beyond the sustained
#: range, or a spike with a flat one; equal successive readings have probability 1 if stuck and the source's own otherwise,
#: never taken as less than LEAST_EQUAL.
WIDE, SPIKE_DENSITY, IN_RANGE_SPIKE, LEAST_EQUAL = 1.8, 1e-4, 1e-6, 0.08
MOVES = np.array([[1 - 1.1e-3 - 1e-5, 1e-3, 1e-5, 1e-4], [0.7, 0.2, 1e-5, 0.1], [1 / 30, 1e-3, 1 - 1 / 30 - 2e-3, 1e-3], [0.7, 0.1, 1e-5, 0.2]])
#: What the start weighs against a source's own readings: as many transitions out of each state, and readings beyond the range.
PRIOR = 500.0
#: Watts beyond any node's reach.
NODE_WATTS = 100_000.0
#: Readings that are judged at a time, which bounds a worker's memory.
READINGS = 400_000
MOVES = MOVES / MOVES.sum(axis=1, keepdims=True)
#: Window of the running median that defines sustained operation (more than half of it), and length from which a run of equal
#: readings doesn't count as normal behaviour when the source's statistics are taken.
WINDOW, LONG_RUN = 11, 8
#: Counters: the readings before that are tried one by one for the course to go on from (and always the end of the best course so far, however long
#: ago), what a break of the course costs (in readings) if the counter starts anew and otherwise, and how far the rate may exceed the highest sustained one.
BACK, RESTART, BREAK, SLACK = 8, 0.5, 3.5, 1.5

SEQUENCES = "series_id string, capture_id bigint, kind string, n int, lo double, hi double, noise_lo double, noise_hi double, pairs bigint, equal bigint, seq binary"
FLAGS = "sample_id bigint, flag string, probability double"


def measured(text: Column) -> Column:
    """The number that a text states, infinities included; null for NaN, empty and other texts."""
    clean = F.btrim(text, F.lit(" \t\r\n"))
    value = F.when(~clean.rlike("[0-9.][dDfF]$"), clean.try_cast("double"))
    return F.when(~F.isnan(value), value)


def sequences(samples: DataFrame, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """One row per source, capture and chunk: its readings in time order as arrays, and what they say about the source."""
    ts = F.unix_micros("sample_ts")
    kind = F.when(F.col("metric_name").endswith("_total"), "counter").when(F.col("metric_name").endswith("_ratio"), "ratio").otherwise("gauge")
    d = samples.select("series_id", "capture_id", kind.alias("kind"), ts.alias("ts"), measured(F.col("sample_value")).alias("value"), "sample_id").dropna(subset=["series_id", "capture_id", "ts", "value", "sample_id"])
    near = F.array_distinct(F.array(floor_div(F.col("ts"), chunk), floor_div(F.col("ts") - margin, chunk), floor_div(F.col("ts") + margin, chunk)))
    d = d.select("*", F.explode(near).alias("chunk"))
    d = d.withColumn("own", floor_div(F.col("ts"), chunk) == F.col("chunk"))
    keys = ["series_id", "capture_id", "chunk"]
    d = d.repartition(*keys).sortWithinPartitions(*keys, "ts", "value", "sample_id")
    return d.mapInPandas(_sequences, SEQUENCES)


def _sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut sorted rows into sequences; a sequence may go on in the next batch."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        key = pdf.series_id.eq(pdf.series_id.iloc[-1]) & pdf.capture_id.eq(pdf.capture_id.iloc[-1]) & pdf.chunk.eq(pdf.chunk.iloc[-1]) if len(pdf) else []
        last = int(np.argmax(np.asarray(key))) if len(pdf) else 0
        rest = pdf.iloc[last:]
        if last:
            yield _summaries(pdf.iloc[:last])
    if rest is not None and len(rest):
        yield _summaries(rest)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Positions at which any of the columns changes, 0 first."""
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _runs(value: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every reading: the number of its run of equal readings within the sequence, and per run its length."""
    change = np.ones(len(value), bool)
    change[1:] = (value[1:] != value[:-1]) | (seq[1:] != seq[:-1])
    run = np.cumsum(change) - 1
    return run, np.bincount(run)


def _per_sequence(seq: np.ndarray, x: np.ndarray, count: int, f) -> np.ndarray:
    """``f`` (a ufunc's reduceat) of the values of every sequence; NaN where it has none. ``seq`` is sorted."""
    out = np.full(count, np.nan)
    if len(x):
        at = _starts(seq)
        out[seq[at]] = f(x, at)
    return out


def _median_per_sequence(seq: np.ndarray, x: np.ndarray, count: int) -> np.ndarray:
    out = np.full(count, np.nan)
    if len(x):
        order = np.lexsort((x, seq))
        s, y = seq[order], x[order]
        at = _starts(s)
        end = np.append(at[1:], len(s))
        out[s[at]] = (y[(at + end - 1) // 2] + y[(at + end) // 2]) / 2
    return out


def _sustained(seq: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest running median of every sequence; NaN for one that is shorter than the window."""
    lo = hi = np.full(count, np.nan)
    if len(x) >= WINDOW:
        windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)
        first, last = seq[: len(x) - WINDOW + 1], seq[WINDOW - 1 :]
        whole = first == last
        if whole.any():
            middle = np.partition(windows[whole], WINDOW // 2, axis=1)[:, WINDOW // 2]
            lo, hi = _per_sequence(first[whole], middle, count, np.minimum.reduceat), _per_sequence(first[whole], middle, count, np.maximum.reduceat)
    return lo, hi


def _summaries(pdf: pd.DataFrame) -> pd.DataFrame:
    ts, value, sample = pdf.ts.to_numpy(), pdf.value.to_numpy(), pdf.sample_id.to_numpy()
    at = _starts(pdf.series_id.to_numpy(), pdf.capture_id.to_numpy(), pdf.chunk.to_numpy())
    end, count = np.append(at[1:], len(pdf)), len(at)
    seq = np.repeat(np.arange(count), end - at)
    kind = pdf.kind.to_numpy()[at]
    counter = (kind == "counter")[seq]
    # one row per reading: repeated rows, infinities and negatives say nothing about the source
    fresh = np.ones(len(pdf), bool)
    fresh[1:] = (ts[1:] != ts[:-1]) | (value[1:] != value[:-1]) | (seq[1:] != seq[:-1])
    ok = fresh & np.isfinite(value) & (value >= 0)
    s, t, v, c = seq[ok], ts[ok], value[ok], counter[ok]
    run, length = _runs(v, s)
    first = np.ones(len(v), bool)
    first[1:] = run[1:] != run[:-1]
    pair = np.zeros(len(v), bool)
    pair[1:] = s[1:] == s[:-1]
    plain = pair & (length[run] < LONG_RUN)
    pairs, equal = np.bincount(s[plain], minlength=count), np.bincount(s[plain & ~first], minlength=count)
    s, t, v, c = s[first], t[first], v[first], c[first]
    lo, hi, noise_lo, noise_hi = (np.full(count, np.nan) for _ in range(4))
    g = ~c
    a, b = _sustained(s[g], v[g], count)
    step = np.abs(np.diff(v[g]))
    both = (s[g][1:] == s[g][:-1]) & (step > 0)
    middle = ((a + b) / 2)[s[g][1:]]
    upper = v[g][1:] >= middle
    noise_lo, noise_hi = _median_per_sequence(s[g][1:][both & ~upper], step[both & ~upper], count), _median_per_sequence(s[g][1:][both & upper], step[both & upper], count)
    dt, dv, sc = np.diff(t[c]) / 1e6, np.diff(v[c]), s[c]
    rising = (sc[1:] == sc[:-1]) & (dv > 0) & (dt > 0)
    ra, rb = _sustained(sc[1:][rising], dv[rising] / dt[rising], count)
    is_counter = kind == "counter"
    lo, hi = np.where(is_counter, ra, a), np.where(is_counter, rb, b)
    rows = np.empty(len(pdf), dtype=[("t", "<i8"), ("v", "<f8"), ("id", "<i8"), ("own", "<i1")])
    rows["t"], rows["v"], rows["id"], rows["own"] = ts, value, sample, pdf.own.to_numpy()
    data = rows.tobytes()
    size = rows.dtype.itemsize
    return pd.DataFrame({
        "series_id": pdf.series_id.to_numpy()[at], "capture_id": pdf.capture_id.to_numpy()[at], "kind": kind, "n": (end - at).astype("int32"), "lo": lo, "hi": hi, "noise_lo": noise_lo, "noise_hi": noise_hi,
        "pairs": pairs.astype("int64"), "equal": equal.astype("int64"), "seq": [data[i * size : j * size] for i, j in zip(at, end)],
    })


def source_statistics(seqs: DataFrame) -> DataFrame:
    """What every source normally does, over all its captures: one row per ``series_id``."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return seqs.groupBy("series_id").agg(
        F.min(known("lo")).alias("s_lo"), F.max(known("hi")).alias("s_hi"),
        F.min_by("noise_lo", F.when(~F.isnan("noise_lo"), F.col("lo"))).alias("s_noise_lo"), F.max_by("noise_hi", F.when(~F.isnan("noise_hi"), F.col("hi"))).alias("s_noise_hi"),
        ((F.sum("equal") + 0.5) / (F.sum("pairs") + 1.0)).alias("s_equal"),
    )


def implausible(samples: DataFrame, least: int = 50_000, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """``sample_id, flag, probability`` of every implausible row of the metric matrix; flag is spike, stuck, out_of_range, or local: a spike that stays
    within what its source shows elsewhere, but is far from its readings around it.

    Rows with a null in source, capture, time or id, and texts that state no number (NaN, empty) are no readings: they are
    neither flagged nor do they end a run of equal readings. Repeated rows of one reading share its verdict. An empty table gives
    no rows; a source none of whose captures has WINDOW readings shows no range of its own and is judged by hard bounds and runs only.
    """
    seqs = checkpointed(sequences(samples, chunk, margin))  # sorted and summarised once, read four times
    key = ["series_id"]
    hot = hot_keys(seqs, key, least=max(1, least // 1000))
    left = salted(seqs.drop("lo", "hi", "noise_lo", "noise_hi", "pairs", "equal").withColumn("_row", F.xxhash64("capture_id", F.md5("seq"))), hot, key, "_row").drop("_row")
    columns = ["series_id", "kind", "seq", "s_lo", "s_hi", "s_noise_lo", "s_noise_hi", "s_equal", "moves", "wide"]
    start = source_statistics(seqs).withColumn("moves", F.array(*[F.lit(float(x)) for x in MOVES.ravel()])).withColumn("wide", F.lit(WIDE))
    expected = left.join(copied(start, hot, key), ["series_id", "_salt"]).select(*columns).mapInPandas(_expect, EXPECTED)
    sums = expected.groupBy("series_id").agg(*[F.sum(F.col("moved")[i]).alias(f"_m{i}") for i in range(16)], F.sum("beyond").alias("_beyond"), F.sum("squares").alias("_squares"))
    # transitions and the spread of normal excursions as expected under the first model, with the start as prior. The moves into and out of stuck stay as
    # they are: where readings are coarse, runs by chance would otherwise teach the model that the source often sticks
    free = [NORMAL, SPIKE, OUTSIDE]
    weight = {(i, j): F.col(f"_m{4 * i + j}") + PRIOR * float(MOVES[i, j]) for i in free for j in free}
    row = {i: sum((weight[i, j] for j in free[1:]), weight[i, free[0]]) for i in free}
    moves = F.array(*[weight[i, j] / row[i] * float(1 - MOVES[i, STUCK]) if i in free and j in free else F.lit(float(MOVES[i, j])) for i in range(4) for j in range(4)])
    wide = F.sqrt((F.col("_squares") + PRIOR * WIDE**2) / (F.col("_beyond") + PRIOR))
    model = start.drop("moves", "wide").join(sums.select("series_id", moves.alias("moves"), wide.alias("wide")), "series_id")
    return left.join(copied(model, hot, key), ["series_id", "_salt"]).select(*columns).mapInPandas(_judge, FLAGS)


EXPECTED = "series_id string, moved array<double>, beyond double, squares double"
READING = np.dtype([("t", "<i8"), ("v", "<f8"), ("id", "<i8"), ("own", "<i1")])
STATISTICS = ("s_lo", "s_hi", "s_noise_lo", "s_noise_hi", "s_equal", "wide")


def _parts(pdf: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """Sequences of one kind and like length, at most READINGS readings (or one sequence) at a time."""
    for kind in ("counter", "gauge", "ratio"):
        part = pdf[pdf.kind == kind]
        n = part.seq.map(len).to_numpy() // READING.itemsize
        order = np.argsort(n, kind="stable")
        part, n = part.iloc[order], n[order]
        a = 0
        while a < len(part):
            # sequences are padded to the longest, the last of them: as many as fit
            z = a + max(1, int(np.searchsorted(n[a:] * np.arange(1, len(n) - a + 1), READINGS, side="right")))
            yield kind, part.iloc[a:z]
            a = z


def _read(kind: str, part: pd.DataFrame):
    """Rows of the sequences, their readings (repeated rows once) and what the model knows of their sources."""
    arrays = [np.frombuffer(b, READING) for b in part.seq]
    rows = np.concatenate(arrays)
    seq = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    t, v = rows["t"] / 1e6, rows["v"]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["t"][1:] != rows["t"][:-1]) | (v[1:] != v[:-1]) | (seq[1:] != seq[:-1])
    stats = {c: part[c].to_numpy(dtype=float, na_value=np.nan) for c in STATISTICS}
    stats["moves"] = np.stack(part.moves.to_numpy()).reshape(-1, 4, 4)
    own = rows["own"][fresh] == 1
    look = _look_at_counters if kind == "counter" else _look_at_gauges
    beyond, local, impossible = look(seq[fresh], t[fresh], v[fresh], stats, kind == "ratio")
    return rows, np.cumsum(fresh) - 1, seq[fresh], v[fresh], own, beyond, local, impossible, stats


def _expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for kind, part in _parts(pdf):
            _, _, seq, v, own, beyond, local, impossible, stats = _read(kind, part)
            post, moved = _posteriors(seq, v, beyond, impossible, stats, own)
            near = (beyond > 0) & (beyond < 1e5) & own & ~impossible
            count = len(part)
            normal = np.bincount(seq[near], post[near, NORMAL], minlength=count)
            squares = np.bincount(seq[near], post[near, NORMAL] * beyond[near] ** 2, minlength=count)
            yield pd.DataFrame({"series_id": part.series_id.to_numpy(), "moved": list(moved.reshape(count, 16)), "beyond": normal, "squares": squares})


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = np.array(["normal", "spike", "stuck", "out_of_range", "local"], dtype=object)
    for pdf in batches:
        for kind, part in _parts(pdf):
            rows, reading, seq, v, own, beyond, local, impossible, stats = _read(kind, part)
            flag, probability = _decide(seq, v, beyond, impossible, stats)
            # in range, but far from the level around: a spike between two normal readings against a normal one
            move, wide = stats["moves"][seq], stats["wide"][seq]
            spike = SPIKE_DENSITY * move[:, NORMAL, SPIKE] * move[:, SPIKE, NORMAL]
            normal = np.exp(np.maximum(-0.5 * (local / wide) ** 2, -600)) / (wide * 2.5) * move[:, NORMAL, NORMAL] ** 2
            far = (flag == NORMAL) & (local > 0) & (spike > normal)
            flag, probability = np.where(far, LOCAL, flag), np.where(far, spike / (spike + normal), probability)
            out = flag[reading]
            hit = (out != NORMAL) & (rows["own"] == 1)
            yield pd.DataFrame({"sample_id": rows["id"][hit], "flag": names[out[hit]], "probability": np.round(probability[reading][hit], 6)})


#: A reading within its source's range counts as far off only beyond this many noise widths from the median around it.
LOCAL, FAR = 4, 12.0


def _look_at_gauges(seq, t, v, stats, ratio):
    """Noise widths beyond the sustained range, noise widths from the level around (0 unless FAR), and impossible values."""
    impossible = (v < 0) | ~np.isfinite(v) | ((v > 1) if ratio else (v > NODE_WATTS))
    lo, hi = stats["s_lo"][seq], stats["s_hi"][seq]
    width = lambda noise, level: np.maximum(np.nan_to_num(stats[noise][seq]) / 0.954, 0.004 * np.abs(level) + 1e-12)  # noqa: E731  median step of normal noise
    up, down = width("s_noise_hi", hi), width("s_noise_lo", lo)
    with np.errstate(all="ignore"):
        beyond = np.where(v > hi, (v - hi) / up, np.where(v < lo, (lo - v) / down, 0.0))
        off = np.abs(v - _level(seq, v)) / np.maximum(up, down)
    beyond = np.where(impossible | np.isnan(beyond), 0.0, np.minimum(beyond, 1e6))
    off = np.where(impossible | np.isnan(off) | (off < FAR), 0.0, np.minimum(off, 1e6))
    return beyond, off, impossible


def _level(seq: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Median of the WINDOW readings around each (at a sequence's ends of its first or last ones); NaN in shorter sequences."""
    out = np.full(len(v), np.nan)
    if len(v) >= WINDOW:
        windows = np.lib.stride_tricks.sliding_window_view(v, WINDOW)
        middle = np.partition(windows, WINDOW // 2, axis=1)[:, WINDOW // 2]
        length = np.bincount(seq)
        end = np.cumsum(length)
        start = (end - length)[seq]
        at = np.clip(np.arange(len(v)) - WINDOW // 2, start, np.maximum(end[seq] - WINDOW, start))
        whole = length[seq] >= WINDOW
        out[whole] = middle[at[whole]]
    return out


def _look_at_counters(seq, t, v, stats, ratio):
    impossible = (v < 0) | ~np.isfinite(v)
    run, length = _runs(v, seq)
    first = np.ones(len(v), bool)
    first[1:] = run[1:] != run[:-1]
    usable = ~impossible & (first | (length[run] < LONG_RUN))  # of a long run only the first reading can lie on the course
    off = np.zeros(len(v), bool)
    off[usable] = ~_on_course(seq[usable], t[usable], v[usable], stats["s_hi"])
    return np.where(off, 1e6, 0.0), np.zeros(len(v)), impossible


def _padded(seq: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of every reading within its sequence, and the sequences' lengths."""
    length = np.bincount(seq, minlength=count)
    return np.arange(len(seq)) - np.repeat(np.cumsum(length) - length, length), length


def _on_course(seq: np.ndarray, t: np.ndarray, v: np.ndarray, top_rate: np.ndarray) -> np.ndarray:
    """Which counter readings lie on the best course: as many readings as possible of which each follows from one of the BACK
    readings before it, at a rate between 0 and the highest sustained one, breaks of the course being paid for."""
    count = len(top_rate)
    pos, length = _padded(seq, count)
    steps = int(length.max()) if len(length) else 0
    T, V = np.full((steps, count), np.nan), np.full((steps, count), np.nan)
    T[pos, seq], V[pos, seq] = t, v
    rate = np.where(np.isnan(top_rate), NODE_WATTS, top_rate * SLACK)
    score, back = np.full((steps, count), -np.inf), np.full((steps, count), -1, np.int32)
    top, top_at = np.full(count, 0.0), np.full(count, -1, np.int32)  # best score of any course so far and where it ends
    cols = np.arange(count)
    with np.errstate(all="ignore"):
        for i in range(steps):
            here = ~np.isnan(V[i])
            gap = T[i] - T[i - 1] if i else np.full(count, np.inf)
            anew = V[i] <= rate * np.maximum(gap, 1.0) * 2
            best, at = top - np.where((i == 0) | (top_at < 0), 0.0, np.where(anew, RESTART, BREAK)), top_at.copy()
            if i:  # however long a disturbance is, the best course so far may go on after it
                rise, span = V[i] - V[top_at, cols], T[i] - T[top_at, cols]
                best = np.where((top_at >= 0) & (rise >= 0) & (rise <= rate * span + 1e-9 * np.abs(V[i])), top, best)
            for j in range(1, min(BACK, i) + 1):
                rise, span = V[i] - V[i - j], T[i] - T[i - j]
                fits = (rise >= 0) & (rise <= rate * span + 1e-9 * np.abs(V[i]))
                better = fits & (score[i - j] > best)
                best, at = np.where(better, score[i - j], best), np.where(better, i - j, at)
            score[i], back[i] = np.where(here, best + 1, -np.inf), at
            better = here & (score[i] >= top)
            top, top_at = np.where(better, score[i], top), np.where(better, i, top_at)
    on = np.zeros((steps, count), bool)
    at = top_at.copy()
    while (at >= 0).any():
        live = at >= 0
        on[at[live], cols[live]] = True
        at = np.where(live, back[np.maximum(at, 0), cols], -1)
    return on[pos, seq]


def _posteriors(seq: np.ndarray, v: np.ndarray, beyond: np.ndarray, impossible: np.ndarray, stats: dict, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over all sequences at once: the states' probabilities of every reading, and with ``own`` the expected transitions of every
    sequence into its own readings."""
    count = len(stats["s_equal"])
    moves, wide = stats["moves"], stats["wide"][seq]
    same = np.zeros(len(v), bool)
    same[1:] = (seq[1:] == seq[:-1]) & (v[1:] == v[:-1])
    began = np.zeros(len(v), bool)
    began[1:] = seq[1:] == seq[:-1]
    p = np.maximum(np.nan_to_num(stats["s_equal"], nan=LEAST_EQUAL), LEAST_EQUAL)[seq]
    plain = np.where(same, p, np.where(began, 1 - p, 1.0))
    normal = np.exp(np.maximum(-0.5 * (beyond / wide) ** 2, -600)) / (wide * 2.5)
    spike = np.where(beyond > 0, SPIKE_DENSITY, IN_RANGE_SPIKE)
    E = np.empty((len(v), 4))
    E[:, NORMAL], E[:, SPIKE] = normal * plain, spike * plain
    E[:, STUCK] = np.where(same, np.maximum(normal, SPIKE_DENSITY), 1e-12)
    E[:, OUTSIDE] = 1e-12
    E[impossible] = np.array([0.0, 0.0, 0.0, 1.0])
    E[impossible & same, STUCK] = 1e-3
    E = np.maximum(E, 1e-300)
    pos, length = _padded(seq, count)
    steps = int(length.max())
    B = np.ones((steps, count, 4))
    B[pos, seq] = E
    A = np.empty_like(B)
    a = np.tile(np.array([0.97, 0.01, 0.01, 0.01]), (count, 1)) * B[0]
    A[0] = a = a / a.sum(axis=1, keepdims=True)
    for i in range(1, steps):
        a = (a[:, None, :] @ moves)[:, 0] * B[i]
        a /= a.sum(axis=1, keepdims=True)
        A[i] = a
    moved = None if own is None else np.zeros((count, 4, 4))
    counts = np.zeros((steps, count))
    if own is not None:
        counts[pos, seq] = own
    back = np.ascontiguousarray(moves.transpose(0, 2, 1))
    b = np.ones((count, 4))
    for i in range(steps - 2, -1, -1):
        ahead = b * B[i + 1]
        if moved is not None:
            x = A[i][:, :, None] * moves * ahead[:, None, :]
            moved += x * (counts[i + 1] / x.sum(axis=(1, 2)))[:, None, None]
        b = (ahead[:, None, :] @ back)[:, 0]
        b /= b.sum(axis=1, keepdims=True)
        A[i] *= b
    post = A[pos, seq]
    return post / post.sum(axis=1, keepdims=True), moved


def _decide(seq: np.ndarray, v: np.ndarray, beyond: np.ndarray, impossible: np.ndarray, stats: dict) -> tuple[np.ndarray, np.ndarray]:
    """The most probable state of every reading and its probability."""
    same = np.zeros(len(v), bool)
    same[1:] = (seq[1:] == seq[:-1]) & (v[1:] == v[:-1])
    post, _ = _posteriors(seq, v, beyond, impossible, stats)
    flag, probability = post.argmax(axis=1), post.max(axis=1)
    flag = np.where(impossible, OUTSIDE, flag)
    # the whole run counts as stuck, its first reading included
    run, size = _runs(v, seq)
    stuck = np.zeros(len(size), bool)
    stuck[run[(flag == STUCK) & same]] = True
    whole = stuck[run] & ~impossible
    flag = np.where((flag == STUCK) & ~whole & ~impossible, NORMAL, flag)
    return np.where(whole, STUCK, flag), np.where(whole & (flag != STUCK), post[:, STUCK], probability)
