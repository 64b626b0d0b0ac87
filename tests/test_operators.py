"""Operators on hand-made data: expected numbers, boundaries, ties, and futures that must not show."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import accounting as ac
from emberline.operators import asof, exhaustive as ex, experiment, features as fe, gate, lowcarbon as lc, metricsql as mq, models, series as se

H = 3600


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- series


def test_hourly_mean_and_gaps(spark, rows):
    d = frame(spark, [(0, 30.0), (1800, 38.0), (7200, 30.0), (7300, float("nan")), (None, 5.0)], "t bigint, v double")
    assert rows(se.resample(d, [], "t", H, {"v": "avg"})) == [(0, 34.0), (7200, 30.0)]
    assert rows(se.regularize(se.resample(d, [], "t", H, {"v": "avg"}).withColumn("k", F.lit(1)), ["k"], "t", H), "t", "v") == [(0, 34.0), (3600, None), (7200, 30.0)]


def test_canonical_is_tolerant_and_keeps_the_last(spark, rows):
    raw = frame(spark, [("2024-01-01T00:00:00Z", "5", 1), ("2024-01-01T00:00:00Z", "x", 2), ("never", "7", 3), (None, "7", 4)], "time string, a string, seq int")
    assert rows(se.canonical(raw, {"a": "x_mw"}, ["x_mw", "y_mw"], "time", "seq")) == [(1704067200, None, None)]
    with pytest.raises(ValueError):
        se.canonical(raw, {}, ["x"], "date", "seq")


def test_later_layers_win_and_missing_is_not_zero(spark, rows):
    a, b = frame(spark, [(1, 1.0), (2, 2.0)], "t int, v double"), frame(spark, [(2, None), (3, 9.0)], "t int, v double")
    assert rows(se.layered([a, b], ["t"])) == [(1, 1.0), (2, None), (3, 9.0)]


def test_physical_intensity(spark):
    parts = {"coal_mw": 5.0, "fuel_oil_mw": 2.0, "gas_mw": 10.0, "bioenergy_mw": 5.0, "nuclear_mw": 60.0, "wind_mw": 10.0, "hydro_mw": 5.0, "solar_mw": 3.0}
    schema = ", ".join(f"{k} double" for k in parts)
    d = frame(spark, [tuple(parts.values()), (None, *list(parts.values())[1:]), (-5.0, *list(parts.values())[1:]), (0.0,) * 8], schema)
    got = [r[0] for r in d.select(se.proxy_intensity()).collect()]
    assert got[0] == pytest.approx((986 * 5 + 777 * 2 + 429 * 10 + 494 * 5) / 100)
    assert got[1] is None and got[2] == pytest.approx((777 * 2 + 429 * 10 + 494 * 5) / 95) and got[3] is None


def test_regimes(spark):
    d = frame(spark, [(0.0,), (499.9,), (500.0,), (2499.0,), (2500.0,), (None,)], "g double")
    assert [r[0] for r in d.select(se.regime(F.col("g"))).collect()] == [0, 0, 1, 1, 2, None]
    with pytest.raises(ValueError):
        se.regime(F.col("g"), 10, 5)


# -- low-carbon windows


def series(spark, values, t0=0):
    return frame(spark, [("z", t0 + i * H, v) for i, v in enumerate(values)], "zone string, t bigint, v double")


def test_scores(spark, rows):
    s = series(spark, [10.0, 20.0, 30.0, 40.0])
    assert [r[1] for r in rows(lc.rank_score(s, ["zone"]), "t", "score")] == [0.75, 0.5, 0.25, 0.0]
    assert [round(r[1], 4) for r in rows(lc.min_max_score(s, ["zone"]), "t", "score")] == [1.0, 0.6667, 0.3333, 0.0]
    assert [r[1] for r in rows(lc.threshold_score(s, ["zone"]), "t", "score")] == [1.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in rows(lc.min_max_score(series(spark, [5.0, 5.0]), ["zone"]), "score")] == [0.5, 0.5]


def test_two_dips_lower_first(spark, rows):
    v = [50.0] * 48
    v[10:13], v[30:34] = [12.0] * 3, [10.0] * 4
    w = rows(lc.low_carbon_windows(series(spark, v), ["zone"], enter_value=20, leave_value=20, merge_gap=0), "rank", "start", "end", "hours", "mean")
    assert w == [(1, 30 * H, 34 * H, 4, 10.0), (2, 10 * H, 13 * H, 3, 12.0)]


def test_hysteresis_equals_state_machine(spark, rows):
    import random

    rng = random.Random(1)
    for _ in range(4):
        v = [rng.choice([None, *range(0, 100, 7)]) for _ in range(60)]
        v = [None if x is None else float(x) for x in v]
        runs, start, last = [], None, None
        for i, x in enumerate(v):
            if x is None:
                continue
            stay = x <= 90 and (x <= 50 or x <= 5)
            if start is None:
                if stay and x <= 25:
                    start = last = i
            elif stay:
                last = i
            else:
                runs.append((start * H, last * H))
                start = None
        if start is not None:
            runs.append((start * H, last * H))
        got = lc.run_spans(lc.hysteresis_runs(series(spark, v), ["zone"], F.lit(25.0), F.lit(50.0), F.lit(5.0), F.lit(90.0)), ["zone"])
        assert rows(got, "first", "last") == runs


def test_long_block_is_cut_to_its_best_slice(spark, rows):
    w = rows(lc.low_carbon_windows(series(spark, [9.0, 1.0, 1.0, 1.0, 9.0, 50.0, 60.0]), ["zone"], enter_value=10, leave_value=10, longest=3), "start", "end")
    assert w == [(H, 4 * H)]
    assert lc.low_carbon_windows(series(spark, [None, None]), ["zone"]).count() == 0


def test_iou(spark, rows):
    a, b = frame(spark, [(0, 4 * H)], "start bigint, end bigint"), frame(spark, [(2 * H, 6 * H)], "start bigint, end bigint")
    assert rows(lc.hour_iou(a, b))[0] == (2 / 6, 2, 6)
    assert rows(lc.hour_iou(a.limit(0), b.limit(0)))[0] == (1.0, 0, 0)


# -- exhaustive windows


def predictions(spark, prediction, actual, model="m"):
    n = len(actual)
    return frame(spark, [(model, 0, h + 1, (h + 1) * H, float(prediction[h]), float(actual[h])) for h in range(n)], "model string, origin bigint, horizon int, target bigint, prediction double, actual double")


def test_catalog_counts_and_ends(spark, rows):
    p = predictions(spark, range(1, 25), range(1, 25))
    assert ex.catalog(p).count() == 300
    c = rows(ex.catalog(p, durations=[1, 3, 24]), "duration", "start", "predicted")
    assert len(c) == 47 and [x for x in c if x[0] == 3][0] == (3, 1, 2.0) and [x for x in c if x[0] == 3][-1] == (3, 22, 23.0)
    for bad in ([], [0], [25], [True], [1.5]):
        with pytest.raises(ValueError):
            ex.valid_durations(bad, 24)


def test_ties_go_to_the_earliest(spark):
    p = predictions(spark, [9, 2, 0] + [7] * 21, [10, 1, 1] + [8] * 21)
    d = ex.decisions(ex.catalog(p, durations=[1])).first()
    assert (d.selected_start, d.oracle_start, d.oracle_ties, d.top1, d.regret, d.rank) == (3, 2, 2, True, 0.0, 1)
    const = ex.decisions(ex.catalog(predictions(spark, [1] * 24, [2] * 24), durations=[1])).first()
    assert const.spearman is None and const.predicted_ties == 24


def test_potential_is_a_ratio_of_sums_not_clipped(spark):
    d = frame(spark, [(4.0, 10.0), (-5.0, 1.0)], "savings double, opportunity double")
    assert d.agg(ex.potential("savings", "opportunity")).first()[0] == pytest.approx(100 * -1 / 11)
    assert d.filter("false").agg(ex.potential("savings", "opportunity")).first()[0] is None


def test_broken_queries_are_named(spark):
    p = predictions(spark, [1.0] * 24, [1.0] * 24)
    ex.assert_complete(p)
    broken = p.filter("horizon <> 5").unionByName(p.filter("horizon = 6").withColumn("actual", F.lit(float("nan"))))
    with pytest.raises(ValueError, match="not_finite, duplicate_key, incomplete_horizons"):
        ex.assert_complete(broken)


def test_bootstrap_surrounds_the_mean_and_repeats(spark):
    v = frame(spark, [("a", i, float(i % 7)) for i in range(70)], "k string, o int, v double")
    r = ex.block_bootstrap(v, ["k"], "o", "v", 7, 300).first()
    assert r.low <= 3.0 <= r.high and r.high - r.low < 2 and r.draws == 300
    assert ex.block_bootstrap(v.repartition(7), ["k"], "o", "v", 7, 300).first() == r
    assert ex.block_bootstrap(v.withColumn("v", F.lit(2.0)), ["k"], "o", "v", 20, 50).first().high == 2.0


def test_policy(spark):
    p = predictions(spark, [10] * 12 + [5] * 12, [10] * 12 + [5] * 12)
    a = ex.policy(ex.catalog(p, durations=[3]), 3, 24).first()
    assert (a.decision, a.start, a.reduction_pct) == ("DEFER", 13, 50.0)
    b = ex.policy(ex.catalog(p, durations=[3]), 3, 12).first()
    assert (b.decision, b.start, b.chosen_actual) == ("RUN_NOW", 1, 10.0)


# -- accounting


def counter(spark, samples, start, end, **kw):
    s = frame(spark, [("p", float(t), float(v)) for t, v in samples], "pod string, ts double, joules double")
    w = frame(spark, [("p", float(start), float(end))], "pod string, start double, end double")
    return ac.measure(ac.increments(s, w, "pod", **kw), w, "pod").first()


def test_counter_with_reset_and_cut_bounds(spark):
    m = counter(spark, [(0, 100), (30, 400), (60, 50), (90, 350)], 0, 90)
    assert (m.joules, m.resets, m.increments, m.coverage) == (650.0, 1, 3, 1.0)
    part = counter(spark, [(0, 0), (100, 100)], 25, 75)
    assert part.joules == 50.0 and part.coverage == 1.0


def test_counter_partial_and_missing(spark):
    m = counter(spark, [(60, 100), (80, 160)], 40, 100)
    assert m.joules == 60.0 and m.coverage == pytest.approx(1 / 3) and m.note_start and m.note_end
    none = counter(spark, [(5, 1)], 0, 10)
    assert (none.joules, none.samples, none.coverage) == (0.0, 0, 0.0)
    created = counter(spark, [(30, 600), (60, 600)], 0, 60, created=True)
    assert created.joules == 600.0 and "zero" in created.note_start


def test_increments_add_up(spark):
    s = frame(spark, [("p", float(t), float(t * 3 % 50)) for t in range(0, 200, 10)], "pod string, ts double, joules double")
    w = frame(spark, [("p", 15.0, 155.0)], "pod string, start double, end double")
    total = ac.increments(s, w, "pod").agg(F.sum("joules")).first()[0]
    assert ac.measure(ac.increments(s, w, "pod"), w, "pod").first().joules == pytest.approx(total)


def test_energy_weighted_intensity_and_age(spark):
    inc = frame(spark, [("j", "FR", 0.0, 10.0, 3.6e6), ("j", "FR", 100.0, 110.0, 3 * 3.6e6), ("j", "FR", 9000.0, 9010.0, 1.0), ("j", None, 0.0, 10.0, 1.0)], "job string, zone string, start double, end double, joules double")
    c = frame(spark, [("FR", 0, 15.0), ("FR", 50, 35.0), ("FR", 60, -1.0), ("FR", 200, 99.0)], "zone string, t bigint, carbon double")
    r = ac.account(inc, c, "job").first()
    assert r.grams == pytest.approx(15 + 3 * 35) and r.intensity == pytest.approx(30.0) and r.missing == 2


def test_asof_equals_brute_force(spark, rows):
    import random

    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 3000, 3)])) for i in range(300)]
    right = [(rng.choice(["a", "b"]), rng.randint(0, 3000), float(i)) for i in range(60)]
    L, R = frame(spark, left, "id bigint, k string, t bigint"), frame(spark, right, "k string, u bigint, v double")
    expected = []
    for i, k, t in left:
        known = [(u, v) for q, u, v in right if None not in (k, t) and q == k and u <= t and t - u <= 100]
        expected.append((i, *(max(known) if known else (None, None))))
    for least in (50_000, 5):
        got = asof.asof_join(L, R, ["k"], "t", "u", ["v"], 100, "id", least)
        assert rows(got, "id", "matched_at", "v") == sorted(expected)


def test_asof_over_the_whole_hourly_table(spark, tmp_path):
    import datetime

    import __spark_entry__ as entry

    utc = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    at = [(i, h * H + 600) for i, h in enumerate([0, 1, 2, 3, 5, 6, 11, 12])]
    d = frame(spark, [(i, 1, "click", float(i), "{}", utc(t)) for i, t in at], "event_id bigint, user_id bigint, event_type string, value double, props string, ts timestamp")
    d.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.matched_at, r.carbon) for r in entry.queries()["j_asof"](spark, str(tmp_path)).collect()}
    assert got == {i: (t - 600, float(i)) for i, t in at}


def test_asof_tolerance_in_gaps(spark, rows):
    points = frame(spark, [("FR", h * H, float(h)) for h in (0, 1, 2, 6, 11)], "zone string, t bigint, carbon double")
    left = frame(spark, [(i, "FR", float(t)) for i, t in enumerate([2 * H + 7200, 2 * H + 7201, 5 * H, 6 * H, 9 * H, 11 * H - 1, 13 * H])], "id bigint, zone string, ts double")
    got = asof.asof_join(left, points, ["zone"], "ts", "t", ["carbon"], 7200.0, "id")
    assert rows(got, "id", "matched_at") == [(0, 2 * H), (1, None), (2, None), (3, 6 * H), (4, None), (5, None), (6, 11 * H)]


def test_isolation(spark):
    job = frame(spark, [("j", 95.0), ("k", 0.0)], "job string, joules double")
    pods = frame(spark, [("j", "p")], "job string, pod string")
    energy = frame(spark, [("j", "p", 95.0), ("j", "q", 5.0)], "job string, pod string, joules double")
    got = {r.job: (r.share, r.clean) for r in ac.isolation(job, pods, energy).collect()}
    assert got == {"j": (0.05, True), "k": (None, False)}


# -- metrics and experiments


def test_selectors_are_anchored(spark):
    d = frame(spark, [({"a": "xy"}, 0.0, 1.0), ({"a": "x"}, 0.0, 2.0), ({"b": "x"}, 0.0, 4.0)], "labels map<string,string>, ts double, value double")
    total = lambda x: x.agg(F.sum("value")).first()[0]
    assert total(mq.select(d, match={"a": "x"})) == 2.0 and total(mq.select(d, unequal={"a": "x"})) == 5.0 and total(mq.select(d, equal={"a": ""})) == 4.0


def test_trapezoid(spark, rows):
    d = frame(spark, [("a", 0.0, 10.0), ("a", 10.0, 20.0), ("b", 0.0, 5.0)], "k string, ts double, value double")
    assert rows(experiment.trapezoid(d, ["k"]), "k", "joules", "span") == [("a", 150.0, 10.0), ("b", None, 0.0)]


def test_repeatability_of_one_run(spark):
    r = experiment.repeatability(frame(spark, [("a", 5.0)], "k string, e double"), ["k"], ["e"]).first()
    assert r.e_mean == 5.0 and r.e_std is None


# -- features


def test_delivery_day_mask_follows_local_midnight(spark, rows):
    winter, summer = 1705276800, 1720915200  # 00:00 UTC on 2024-01-15 and 2024-07-14
    s = fe.stack(frame(spark, [(winter,), (summer,)], "origin bigint"))
    f = frame(spark, [(o + h * H, float(h)) for o in (winter, summer) for h in range(1, 25)], "t bigint, load_day_ahead double")
    got = fe.at_target(s, f, ["load_day_ahead"]).filter("fc_load_day_ahead is null").groupBy("origin").agg(F.min("horizon").alias("h"))
    assert rows(got, "origin", "h") == [(winter, 23), (summer, 22)]


def test_outages_of_every_hour_equal_those_by_day(spark, rows):
    import random

    rng = random.Random(5)
    base = 1711774800  # 2024-03-30 05:00 UTC, a day before the clock changes
    data = []
    for i in range(150):
        start = base + rng.randint(0, 12 * 24) * 900 * 4 + rng.choice([0, 0, 900])
        data.append((rng.randint(0, 12), rng.choice([None, *(base + h * H for h in range(-60, 300, 7))]), rng.choice(["ACTIVE", "ACTIVE", "DISMISSED"]), rng.choice(["NUCLEAR", "FOSSIL_GAS", "OTHER"]), start, start + rng.randint(-2, 90) * H, rng.randint(1, 50) / 10))
    m = frame(spark, data, "identifier int, pub bigint, status string, fuel string, start bigint, end bigint, mw double")
    got = fe.outage_every_hour(m, ["nuclear", "gas"])
    # brute force: of every outage the rows of the last publication before the local midnight of the hour's day
    from datetime import datetime
    from zoneinfo import ZoneInfo

    def at(t):
        midnight = datetime.fromtimestamp(t, ZoneInfo("Europe/Paris")).replace(hour=0, minute=0).timestamp()
        out = {"NUCLEAR": 0.0, "FOSSIL_GAS": 0.0, "OTHER": 0.0}
        for k in {r[0] for r in data}:
            last = max((r[1] for r in data if r[0] == k and r[1] is not None and r[1] < midnight), default=None)
            for r in data:
                if r[0] == k and r[1] == last is not None and r[2] == "ACTIVE" and r[4] <= t < r[5]:
                    out[r[3]] += r[6]
        return out["NUCLEAR"], out["FOSSIL_GAS"]

    t = [r.t for r in got.orderBy("t").collect()]
    for r in got.collect():
        assert (r.nuclear_mw, r.gas_mw) == pytest.approx(at(r.t), abs=1e-6)
    assert got.filter("nuclear_mw > 0").count() > 20
    valid = [r for r in data if r[1] is not None and r[4] < r[5]]
    assert t == list(range(-(-min(r[4] for r in valid) // H) * H, -(-max(r[5] for r in valid) // H) * H, H))


def test_outage_queries_cover_the_whole_range_of_the_messages(spark):
    import os

    import __spark_entry__ as entry
    from emberline import adapters as ad

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    a, z = ad.messages(spark, d).filter("start < end").agg(F.min("start"), F.max("end")).first()
    out = {r.t: r for r in entry.queries()["f_outage_hourly"](spark, d).collect()}
    assert sorted(out) == list(range(a, z, H))
    known = {r.t: r for r in entry.queries()["f_outage_by_day"](spark, d).collect()}
    assert all((r.nuclear_mw, r.gas_mw) == (out[t].nuclear_mw, out[t].gas_mw) for t, r in known.items())
    thermal = {r.t: r for r in entry.queries()["f_thermal_hourly"](spark, d).collect()}
    assert sorted(thermal) == sorted(out)
    assert all(r.gas_delta_24h == r.gas_tightness - thermal[t - 24 * H].gas_tightness for t, r in thermal.items() if t - 24 * H in thermal)


def test_refit_trains_on_the_whole_history_and_needs_24_rows(spark):
    import pandas as pd
    import pytest

    day = 86400
    data = [(o * day, h, o * day + h * H, float(o * 100 + h)) for o in (0, 1, 70, 71, 200) for h in range(1, 25)]
    d = frame(spark, data, "origin bigint, horizon int, target bigint, actual double")
    count = lambda t, e: pd.Series([t["actual"].sum()] * len(e), index=e.index)
    total = lambda at, since=-1: sum(a for _, _, t, a in data if since < t < at) or None
    got = {(r.origin // day, r.prediction) for r in models.refit_per_origin(d, [], count).collect()}
    assert got == {(o, total(o * day)) for o in (0, 1, 70, 71, 200)}
    got = {(r.origin // day, r.prediction) for r in models.refit_per_origin(d, [], count, 140).filter("origin > 0").collect()}
    assert got == {(o, total(o * day, (o - 140) * day - 1)) for o in (1, 70, 71, 200)}
    with pytest.raises(Exception, match="has 23 targets, expected 24"):
        models.refit_per_origin(d.filter("origin = 0 or horizon < 24"), [], count).collect()


def test_physical_experts_fit_oil_and_total_and_weights(spark):
    import random

    rng = random.Random(1)
    data = []
    for i in range(240):
        x = float(i % 3)
        data.append((i * H, x, i % 3, [100.0, 800.0, 3000.0][i % 3], 10.0, 200.0 + 100 * x if i >= 40 else 0.0, 50.0, 9000.0 + 1000 * x, 20.0 + rng.random()))
    d = frame(spark, data, "t bigint, x double, regime int, gas_mw double, coal_mw double, fuel_oil_mw double, bioenergy_mw double, total_generation_mw double, y double")
    got = models.fit_physical_experts(d, ["x"], "regime", "y", "t", half_life=1.0, trees=8, classes=8, step=0.5, pooled_gas=True)(d.filter("t >= 237 * 3600")).collect()
    for r in got:
        oil, total = 200.0 + 100 * r.x, 9000.0 + 1000 * r.x
        assert abs(r.hat_fuel_oil_mw - oil) < 30 and abs(r.hat_total_generation_mw - total) < 300 and abs(r.denominator - total) < 300
        assert r.prediction_pooled is not None
        grams = 429 * r.gas_mw + 986 * 10 + 777 * oil + 494 * 50
        assert abs(r.prediction - grams / total) < 0.1 * grams / total


def test_bootstrap_draws_and_block_variants(spark):
    import os

    import __spark_entry__ as entry

    v = frame(spark, [("a", i, float(i % 5)) for i in range(20)], "k string, o int, v double")
    assert ex.block_bootstrap(v, ["k"], "o", "v").first().draws == 20_000
    d = "/root/testdata/sf0.001"
    if os.path.isdir(d):
        for name in ("e_bootstrap", "e_bootstrap_week", "e_bootstrap_iid"):
            assert {r.draws for r in entry.queries()[name](spark, d).collect()} == {20_000}


def test_local_midnight_on_days_the_clock_changes(spark):
    from datetime import datetime, timezone

    utc = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp())
    d = frame(spark, [(utc(2025, 3, 30, 12),), (utc(2025, 10, 26, 12),), (utc(2025, 7, 1, 22, 30),)], "t bigint")
    assert [r[0] for r in d.select(fe.local_midnight(F.col("t"))).collect()] == [utc(2025, 3, 29, 23), utc(2025, 10, 25, 22), utc(2025, 7, 1, 22)]


def test_closed_hour_and_lags_ignore_the_future(spark, rows):
    s = fe.stack(frame(spark, [(100 * H,)], "origin bigint"), 30)
    state = frame(spark, [(i * H, float(i)) for i in range(200)], "t bigint, c double")
    assert rows(fe.origin_state(s, state, ["c"]), "origin_c")[0] == (99.0,)
    lags = rows(fe.target_lags(s, state, ["c"], (24,)), "horizon", "tgtlag24_c")
    assert lags[22] == (23, 99.0) and lags[23] == (24, None)


def test_multiscale_ignores_later_values(spark, rows):
    v = [(i * H, float(i)) for i in range(40)]
    ask = lambda x: rows(fe.multiscale(frame(spark, x, "t bigint, c double"), "c", (6,)).filter(F.col("t") <= 20 * H), "t", "w6_level", "w6_trend", "w6_volatility")
    assert ask(v) == ask(v[:21] + [(t, 1e9) for t, _ in v[21:]])
    assert ask(v)[-1][1:3] == (17.5, 1.0)


MESSAGES = "identifier string, message_id string, version int, pub bigint, status string, kind string, fuel string, start bigint, end bigint, mw double"


def test_cancellation_hides_the_older_version(spark):
    m = frame(spark, [("o", "1", 1, 0, "ACTIVE", "UNPLANNED", "NUCLEAR", 0, 10**9, 1000.0), ("o", "2", 2, 50 * H, "DISMISSED", "UNPLANNED", "NUCLEAR", 0, 10**9, 1000.0), ("g", "3", 1, 0, "ACTIVE", "PLANNED", "FOSSIL_GAS", 0, 10**9, 200.0)], MESSAGES)
    s = fe.stack(frame(spark, [(10 * H,), (100 * H,)], "origin bigint"), 2)
    got = {(r.origin, r.horizon): (r.nuclear_mw, r.gas_mw, r.nuclear_planned_mw, r.nuclear_unplanned_mw) for r in fe.availability(m, s, ["nuclear", "gas"]).collect()}
    assert got[(10 * H, 1)] == (1000.0, 200.0, 0.0, 1000.0) and got[(100 * H, 2)] == (0.0, 200.0, 0.0, 0.0)
    old = fe.availability(m, s, ["nuclear"], legacy_planned=True).filter("horizon = 1 and origin = 36000").first()
    assert old.nuclear_planned_mw == 1000.0
    # what has begun or ended since the origin shows as a change; several intervals of one version all count
    m = frame(spark, [("o", "1", 1, 0, "ACTIVE", "PLANNED", "NUCLEAR", 0, 10 * H, 5.0), ("o", "1", 1, 0, "ACTIVE", "PLANNED", "NUCLEAR", 11 * H, 12 * H, 7.0), ("o", "1", 1, 0, "ACTIVE", "PLANNED", "NUCLEAR", 11 * H, 13 * H, 2.0)], MESSAGES)
    s = fe.stack(frame(spark, [(9 * H,)], "origin bigint"), 4)
    got = fe.availability(m, s, ["nuclear"], mode="all").orderBy("horizon").collect()
    assert [(r.nuclear_mw, r.nuclear_delta_mw, r.nuclear_intervals) for r in got] == [(0.0, -5.0, 0), (9.0, 4.0, 2), (2.0, -3.0, 1), (0.0, -5.0, 0)]
    assert fe.availability(m.limit(0), s, ["nuclear"], mode="delta").columns == ["origin", "horizon", "target", "nuclear_delta_mw"]


def test_equal_times_the_last_delivered_sample_counts(spark, rows):
    s = frame(spark, [("a", 0.0, 1.0, 1), ("a", 10.0, 9.0, 2), ("a", 10.0, 4.0, 3), ("a", 10.0, float("nan"), 4), (None, 1.0, 1.0, 5)], "pod string, ts double, joules double, seq bigint")
    assert rows(ac.clean_samples(s.dropna(subset=["pod"]), ["pod"], sequence="seq"), "ts", "v") == [(0.0, 1.0), (10.0, 4.0)]
    assert rows(ac.counter_delta(s, ["pod"], sequence="seq"), "pod", "delta", "samples") == [("a", 3.0, 2), (None, None, 1)]


def test_counters_in_chunks_equal_one_window(spark, rows, monkeypatch):
    import random

    rng = random.Random(2)
    data, v = [], 0.0
    for i in range(400):
        v = rng.choice([v + rng.random(), v + rng.random(), rng.random()]) if i % 37 else 0.1
        data.append(("a", float(i * 50 + rng.random()), v))
    s, w = frame(spark, data, "pod string, ts double, joules double"), frame(spark, [("a", 777.0, 17_777.0)], "pod string, start double, end double")
    ask = lambda: (rows(ac.counter_delta(s, ["pod"]).select("resets", F.round("delta", 6))), rows(ac.measure(ac.increments(s, w, "pod"), w, "pod").select("resets", "samples", F.round("joules", 6))), rows(ac.enclosing_delta(s, w, "pod").select(F.round("delta", 6))))
    whole = ask()
    monkeypatch.setattr(ac, "CHUNK", 300)
    assert ask() == whole


# -- gates


def experts(spark, days, poison=None):
    out = []
    for d in range(days):
        for h in range(1, 25):
            o, t = d * 86400, d * 86400 + h * H
            a = 1e6 if poison is not None and t >= poison else 10.0
            out += [(o, h, t, a, "direct", 20.0), (o, h, t, a, "d1", 10.0)]
    return frame(spark, out, "origin bigint, horizon int, target bigint, actual double, expert string, value double")


def test_gate_falls_back_then_picks_the_better(spark):
    g = gate.raw_gate(experts(spark, 2), ["direct", "d1"], "direct")
    got = {(r.origin, r.horizon): (r.expert, r.n) for r in g.collect()}
    assert got[(0, 1)] == ("direct", None) and got[(86400, 1)] == ("d1", 7) and got[(86400, 24)] == ("d1", 2)


def test_gate_never_sees_labels_at_or_after_the_origin(spark, rows):
    clean, dirty = (gate.raw_gate(experts(spark, 4, p), ["direct", "d1"], "direct").filter(F.col("origin") <= 2 * 86400) for p in (None, 2 * 86400))
    take = lambda d: rows(d, "origin", "horizon", "expert", "mape", "n")
    assert take(clean) == take(dirty)


def test_shrunk_scale(spark):
    e = experts(spark, 2).filter("expert = 'direct'").withColumn("value", F.lit(40 / 3))
    g = gate.calibrated_gate(e, ["direct"], "direct", 7).filter("origin = 86400").first()
    assert g.scale == pytest.approx(0.875) and g.prediction == pytest.approx(0.875 * 40 / 3)


def test_blend_prefers_the_exact_mixture(spark):
    e = experts(spark, 3).withColumn("value", F.when(F.col("expert") == "direct", 20.0).otherwise(0.0))
    b = gate.convex_blend(e, ["direct", "d1"], "direct").filter("origin = 86400").first()
    assert (b.weight_direct, b.prediction) == (0.5, 10.0)
    assert gate.convex_blend(e, ["direct", "d1"], "direct").filter("origin = 0").first().weight_direct == 1.0


def test_physical_variants(spark):
    d = frame(spark, [(50.0, 1000.0, 40.0, 20.0, 20.0, 10.0), (10.0, 1000.0, None, 20.0, None, 10.0)], "p double, total double, b1 double, b double, o1 double, o double")
    r = gate.physical_variants(d, "p", "total", ("b1", "b"), ("o1", "o")).collect()
    assert r[0].with_bio == pytest.approx(50 + 9.88) and r[0].with_bio_oil == pytest.approx(50 + 9.88 + 7.77) and r[1].with_bio_oil == 10.0


def test_sharpening(spark):
    d = frame(spark, [(0.5, 0.3, 0.2)], "a double, b double, c double")
    p = [F.col(x) for x in "abc"]
    r = d.select(*models.sharpened(p, 2.0), *models.hard(p)).first()
    assert sum(r[:3]) == pytest.approx(1) and r[0] == pytest.approx(0.25 / 0.38) and list(r[3:]) == [1.0, 0.0, 0.0]


def test_metrics_leave_out_zero_actuals(spark):
    d = frame(spark, [(10.0, 12.0), (0.0, 5.0), (None, 1.0), (20.0, None)], "actual double, prediction double")
    m = gate.metrics(d, []).first()
    assert (m.mape, m.n, m.bias) == (20.0, 1, 2.0)
