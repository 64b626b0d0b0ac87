"""Problems 1, 3, 4 and 5 on small dirty tables, against brute force."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest

from emberline.operators import anomaly, asknown, intervals, regrid

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
MESSAGES = "row_id bigint, identifier string, message_id string, version int, publication_date timestamp, event_status string, unit_code string, interval_start timestamp, interval_end timestamp, unavailable_capacity_mw double, extra string"
PROBES = "probe_id bigint, identifier string, origin timestamp, target_time timestamp, message_id string"


def hours(x):
    return None if x is None else T0 + timedelta(hours=x)


def random_messages(rng, n=300):
    out = []
    for i in range(n):
        ident = rng.choice(["A", " a", "b ", "B", "C", None])
        version = rng.randint(1, 4)
        # a version has one publication and status; now and then a null or a reversed interval
        pub = {"A": 0, "B": 100, "C": 50}.get((ident or "C").strip().upper(), 0) + [0, 5, 5, 40][version - 1]
        start = rng.randint(0, 400)
        end = start + rng.choice([0, -5, 10, 200, 2000])
        status = ["ACTIVE", "dismissed", " Active", "ACTIVE"][version - 1]
        name = f"{(ident or '-').strip().upper()}_{version}"
        row = [i, ident, name, version, hours(pub), status, rng.choice(["u1", "u2", "u3"]), hours(start), hours(end), rng.choice([0.0, 10.0, 5.5]), "x"]
        if rng.random() < 0.1:
            row[rng.choice([4, 7, 8, 9])] = None
        out.append(tuple(row))
        if rng.random() < 0.2:
            out.append((i + 10_000, *row[1:]))
    return out


def live(messages):
    return [(m[1].strip().upper(), m[2], m[3], m[4], m[5].strip().upper(), m[6], m[7], m[8], m[9]) for m in messages if None not in (m[1], m[4], m[7], m[8], m[9])]


@pytest.mark.parametrize("seed", [1, 2])
def test_state_known_at_origin_equals_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    messages = random_messages(rng)
    probes = [(i, rng.choice(["a", "B ", "C", "nobody", None]), hours(rng.choice([None, *range(-5, 200, 5)])), hours(rng.choice([None, *range(0, 600, 7)])), "clash") for i in range(300)]
    expected = set()
    clean = live(messages)
    for pid, ident, origin, target, _ in probes:
        if None in (ident, origin, target):
            continue
        known = [m for m in clean if m[0] == ident.strip().upper() and m[3] <= origin]
        if known:
            top = max((m[3], m[2]) for m in known)
            expected |= {(pid, m[1]) for m in known if (m[3], m[2]) == top and m[4] == "ACTIVE" and m[6] <= target < m[7]}
    for least in (50_000, 10):
        got = asknown.active_at_target(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(probes, PROBES), least=least)
        assert rows(got, "probe_id", "message_id") == sorted(expected)


def test_later_publications_change_nothing(spark, rows):
    messages = random_messages(random.Random(5))
    probes = [(i, "A", hours(3), hours(i), "c") for i in range(100)]
    poison = [(99_999, "a", "A_9", 9, hours(4), "DISMISSED", "u1", hours(0), hours(900), 1.0, "x")]
    ask = lambda m: rows(asknown.active_at_target(spark.createDataFrame(m, MESSAGES), spark.createDataFrame(probes, PROBES)))
    assert ask(messages) == ask(messages + poison)


def test_empty_tables(spark):
    m, p = spark.createDataFrame([], MESSAGES), spark.createDataFrame([], PROBES)
    assert asknown.active_at_target(m, p).count() == 0
    assert intervals.outage_periods(m).count() == 0


def merged(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("bucket", [intervals.BUCKET, 3_600_000_000, 50 * 3_600_000_000])
def test_interval_periods_equal_brute_force(spark, rows, bucket):
    rng = random.Random(3)
    data = []
    for key in ["a", "b", None]:
        for _ in range(120):
            s = rng.randint(0, 500)
            data.append((key, s * 3_600_000_000, (s + rng.choice([1, 1, 2, 3, 30, 0, -2])) * 3_600_000_000))
        data.append((key, None, 5))
    d = spark.createDataFrame(data, "k string, start_us bigint, end_us bigint")
    expected = [(k, s, e) for k in ["a", "b", None] for s, e in merged([(s, e) for q, s, e in data if q == k and s is not None and e > s])]
    p = intervals.merge_intervals(d, ["k"], bucket=bucket)
    assert rows(p, "k", "start_us", "end_us") == sorted(expected, key=lambda t: tuple((x is None, x) for x in t))
    gaps = [(k, a[1], b[0]) for k in ["a", "b"] for own in [[x[1:] for x in expected if x[0] == k]] for a, b in zip(own, own[1:])]
    assert rows(intervals.period_gaps(p.filter("k is not null"), ["k"], bucket=bucket), "k", "start_us", "end_us") == sorted(gaps)


def test_intervals_one_microsecond_apart_stay_apart(spark, rows):
    d = spark.createDataFrame([("a", 0, 10), ("a", 11, 20), ("a", 20, 30)], "k string, start_us bigint, end_us bigint")
    assert rows(intervals.merge_intervals(d, ["k"])) == [("a", 0, 10), ("a", 11, 30)]


def test_final_periods_equal_brute_force(spark, rows):
    messages = random_messages(random.Random(8))
    clean = live(messages)
    final = {i: max((m[3], m[2]) for m in clean if m[0] == i) for i in {m[0] for m in clean}}
    used = [m for m in clean if (m[3], m[2]) == final[m[0]] and m[4] == "ACTIVE" and m[8] > 0 and m[7] > m[6]]
    expected = []
    for u in {m[5] for m in used}:
        p = merged([(int(m[6].timestamp()), int(m[7].timestamp())) for m in used if m[5] == u])
        expected += [(u, "period", s, e) for s, e in p] + [(u, "gap", a[1], b[0]) for a, b in zip(p, p[1:])]
    got = intervals.outage_periods(spark.createDataFrame(messages, MESSAGES), bucket=7 * 3_600_000_000, least=5)
    assert rows(got, "unit_code", "kind", "start_s", "end_s") == sorted(expected)


SAMPLES = "sample_id bigint, capture_id bigint, series_id string, metric_name string, sample_ts timestamp, sample_value string, extra int"
CAPTURES = "capture_id bigint, started_at timestamp, ended_at timestamp, step_s int"


def at(s):
    return T0 + timedelta(seconds=s)


def test_counter_increments_are_shared_out_over_cells(spark, rows):
    samples = [(1, 1, "c", "x_total", at(5), "100", 0), (2, 1, "c", "x_total", at(25), " +140 ", 0), (3, 1, "c", "x_total", at(25), "140", 0), (4, 1, "c", "x_total", at(45), "10", 0), (5, 1, "c", "x_total", at(58), "NaN", 0), (6, 1, "c", "x_total", None, "7", 0)]
    captures = spark.createDataFrame([(1, at(0), at(70), 10), (2, at(0), at(50), 10)], CAPTURES)
    g = regrid.regular_grid(regrid.series_readings(spark.createDataFrame(samples, SAMPLES)), captures, 10)
    base = int(T0.timestamp())
    got = {c - base: (n, round(a, 6) if a is not None else None, round(v, 6), m) for c, n, a, v, m in rows(g, "cell_s", "readings", "amount", "covered_s", "missing")}
    # 40 over [5, 25), then a reset: 10 over [25, 45)
    assert got == {0: (1, 10.0, 5.0, False), 10: (0, 20.0, 10.0, True), 20: (1, 12.5, 10.0, False), 30: (0, 5.0, 10.0, True), 40: (1, 2.5, 5.0, False), 50: (0, None, 0.0, True), 60: (0, None, 0.0, True)}


def test_number_formats(spark):
    from pyspark.sql import functions as F

    texts = ["1", " 2.5 ", "+3e2", "-4.", ".5", "NaN", "", None, "Inf", "-Infinity", "1e999", "1d", "2f", "0x1", "1,5", "abc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(regrid.finite_number(F.col("t"))).collect()]
    assert got == [1.0, 2.5, 300.0, -4.0, 0.5] + [None] * 11
    raw = [r[0] for r in spark.createDataFrame([(t,) for t in ["+Inf", "-Inf", "NaN", "1d", "1e999", " 7 ", None]], "t string").select(anomaly.measured(F.col("t"))).collect()]
    assert raw == [float("inf"), float("-inf"), None, None, float("inf"), 7.0, None]


def test_instants(spark):
    from pyspark.sql import functions as F

    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00.123456789+02:00", "2023-12-31T19:00:00.5-05:00", "0001-01-01T00:00:00Z", "", None, "soon"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(regrid.instant_us(F.col("t"))).collect()]
    b = int(T0.timestamp()) * 1_000_000
    assert got == [b, b + 123456, b + 500000, None, None, None, None]


@pytest.mark.parametrize("chunk", [regrid.CHUNK, 900_000_000])
def test_missing_cells_equal_brute_force(spark, rows, chunk):
    rng = random.Random(4)
    samples = [(i, rng.choice([1, 2]), rng.choice(["s1", "s2"]), "watts", at(rng.randint(-50, 4000)), rng.choice(["1.5", "NaN", "-2", "", "Inf", None]), 0) for i in range(250)]
    captures = [(1, at(7), at(3601), 15), (2, at(100), at(2000), 7), (3, at(0), at(50), 10)]
    step = {c[0]: c for c in captures}
    expected = []
    for cap, s in {(x[1], x[2]) for x in samples}:
        _, a, z, w = step[cap]
        a, z = a.timestamp(), z.timestamp()
        seen = {int(x[4].timestamp()) // w * w for x in samples if x[1] == cap and x[2] == s and x[5] in ("1.5", "-2")}
        expected += [(cap, s, c) for c in range(int(a) // w * w, int(z) + 1, w) if c + w > a and c < z and c not in seen]
    cd = spark.createDataFrame(captures, CAPTURES)
    from pyspark.sql import functions as F

    g = regrid.regular_grid(regrid.series_readings(spark.createDataFrame(samples, SAMPLES)), cd, F.col("step_s"), max_gap=100_000_000, chunk=chunk)
    assert rows(g.filter("missing"), "capture_id", "source_id", "cell_s") == sorted(expected)
    whole = regrid.regular_grid(regrid.series_readings(spark.createDataFrame(samples, SAMPLES)), cd, F.col("step_s"), max_gap=100_000_000)
    take = lambda d: [(r[0], r[1], r[2], r[3], round(r[4], 6), None if r[5] is None else round(r[5], 6)) for r in rows(d, "capture_id", "source_id", "cell_s", "readings", "covered_s", "value")]
    assert take(g) == take(whole)  # chunks don't show


def series(rng, n=400, cap=1, name="n:w", metric="cpu_watts", first_id=0):
    out = []
    for i in range(n):
        level = 170.0 if 150 <= i < 250 else 65.0
        out.append([first_id + i, cap, name, metric, at(i * 15), f"{level + rng.gauss(0, 1.0):.3f}", 0])
    return out


def flags(spark, samples, **kw):
    return {r.sample_id: r.flag for r in anomaly.implausible(spark.createDataFrame([tuple(s) for s in samples], SAMPLES), **kw).collect()}


@pytest.mark.parametrize("chunk", [anomaly.CHUNK, 2 * anomaly.HOUR // 3])
def test_implausible_gauge_readings(spark, chunk):
    s = series(random.Random(1))
    s[50][5], s[51][5], s[200][5], s[300][5], s[310][5] = "420.0", "431", "3.1", "-65", "+Inf"
    for i in range(320, 345):
        s[i][5] = s[320][5]
    for i in (10, 11):
        s[i][5] = "NaN"
    s.append([5000, *s[50][1:]])  # a repeated row shares the verdict
    s.append([5001, 1, None, "cpu_watts", at(9), "999", 0])
    got = flags(spark, s, chunk=chunk)
    expected = {50: "spike", 51: "spike", 200: "spike", 300: "out_of_range", 310: "out_of_range", 5000: "spike"} | {i: "stuck" for i in range(320, 345)}
    assert got == expected


def test_implausible_counter_readings(spark):
    rng, value, s = random.Random(2), 1000.0, []
    for i in range(300):
        if i == 150:
            value = 20.0  # a genuine restart
        value += rng.uniform(15, 45)
        s.append([i, 1, "n:j", "joules_total", at(i * 15), f"{value:.3f}", 0])
    s[60][5], s[61][5], s[200][5], s[250][5] = "12.5", "700.0", "99999999", "-1"
    freeze = s[100][5]
    for i in range(100, 130):
        s[i][5] = freeze
    got = flags(spark, s)
    assert got == {60: "spike", 61: "spike", 200: "spike", 250: "out_of_range"} | {i: "stuck" for i in range(100, 130)}


def test_quantised_series_has_runs_by_chance(spark):
    rng = random.Random(3)
    s = [[i, 1, "n:w", "cpu_watts", at(i * 15), str(round(66 + rng.gauss(0, 0.7))), 0] for i in range(800)]
    assert flags(spark, s) == {}


def test_anomalies_of_empty_and_tiny_tables(spark):
    assert anomaly.implausible(spark.createDataFrame([], SAMPLES)).count() == 0
    assert flags(spark, [[1, 1, "a", "cpu_watts", at(0), "5", 0], [2, 1, "b", "cpu_ratio", at(1), "1.5", 0], [3, 1, "a", "cpu_watts", at(2), "50", 0]]) == {2: "out_of_range"}


def test_course_of_a_counter():
    t = np.arange(8.0) * 10
    v = np.array([0, 100, 200, 50, 60, 500, 600, 700.0])
    on = anomaly._on_course(np.zeros(8, int), t, v, np.array([10.0]))
    assert on.tolist() == [True, True, True, False, False, True, True, True]


def test_spikes_within_the_source_range_are_local(spark):
    import random
    from datetime import datetime, timedelta, timezone

    rng, t0, data = random.Random(7), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for capture, level in ((1, 100.0), (2, 180.0)):
        for i in range(300):
            v = level + rng.gauss(0, 0.5)
            if (capture, i) in ((1, 150), (1, 151)):
                v = 178.0
            if (capture, i) == (2, 80):
                v = 101.0
            if (capture, i) == (2, 200):
                v = 400.0
            data.append((len(data), capture, "s", "n", "kepler_node_cpu_watts", "package", t0 + timedelta(hours=2 * capture, seconds=15 * i), f"{v:.3f}"))
    d = spark.createDataFrame(data, "sample_id bigint, capture_id bigint, series_id string, node_name string, metric_name string, rapl_zone string, sample_ts timestamp, sample_value string")
    assert {r.sample_id: r.flag for r in anomaly.implausible(d).collect()} == {150: "local", 151: "local", 380: "local", 500: "spike"}


def test_a_course_goes_on_after_a_disturbance_of_any_length():
    n, gone = 48, range(20, 45)
    t = np.arange(n, dtype=float) * 10
    v = np.array([1000.0 + 5 * i if i not in gone else 9e5 - 1000 * i for i in range(n)])
    on = anomaly._on_course(np.zeros(n, int), t, v, np.array([0.6]))
    assert [i for i in range(n) if not on[i]] == list(gone)


def test_batches_hold_a_bounded_number_of_readings(monkeypatch):
    monkeypatch.setattr(anomaly, "READINGS", 1000)
    sizes = [5, 5, 700, 40, 40, 40, 3000, 900]
    pdf = pd.DataFrame({"kind": ["gauge"] * 7 + ["counter"], "seq": [bytes(anomaly.READING.itemsize * n) for n in sizes]})
    parts = [[len(x) // anomaly.READING.itemsize for x in p.seq] for _, p in anomaly._parts(pdf)]
    assert sorted(x for p in parts for x in p) == sorted(sizes) and all(len(p) == 1 or len(p) * max(p) <= 1000 for p in parts)


def test_the_model_is_learned_from_the_readings():
    moves, steps = np.tile(anomaly.MOVES, (1, 1, 1)), 400
    stats = {"s_equal": np.array([0.1]), "moves": moves, "wide": np.array([anomaly.WIDE])}
    beyond = np.where(np.arange(steps) % 8 == 3, 500.0, 0.0)
    v = np.arange(steps, dtype=float)
    post, moved = anomaly._posteriors(np.zeros(steps, int), v, beyond, np.zeros(steps, bool), stats, np.ones(steps, bool))
    assert moved.sum() == pytest.approx(steps - 1) and moved[0, 0, 1] / moved[0, 0].sum() == pytest.approx(1 / 7, abs=0.01)


def test_the_highest_of_readings_at_one_instant_begins_the_next_stretch(spark):
    r = spark.createDataFrame([(1, "s", 10_000_000, 8.0, False), (1, "s", 10_000_000, 2.0, False), (1, "s", 20_000_000, 4.0, False)], "capture_id bigint, source_id string, ts bigint, value double, counter boolean")
    c = spark.createDataFrame([(1, datetime.fromtimestamp(10, timezone.utc), datetime.fromtimestamp(20, timezone.utc))], "capture_id bigint, started_at timestamp, ended_at timestamp")
    assert [(x.cell_s, x.readings, x.value) for x in regrid.regular_grid(r, c, 10).collect()] == [(10, 1, 6.0)]
