"""Payload parsers, remote chunks, sinks and live forms."""

import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from emberline.operators import lowcarbon as lc
from emberline.sources import records, remote, sinks
from emberline.streaming import live


def payloads(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d) if not isinstance(d, str) else d) for i, d in enumerate(docs)], "seq int, value string")


def test_outage_messages(spark, rows):
    m = {"identifier": "o", "message_id": "m1", "version": "2", "publication_date": "2026-01-01T00:00:00+01:00", "event_status": "ACTIVE"}
    v = [{"start_date": "2026-01-02T00:00:00Z", "end_date": "2026-01-03T00:00:00Z", "unavailable_capacity": x} for x in (1000, "500", "x")]
    d = records.outage_messages(payloads(spark, {**m, "values": v[:2]}, {**m, "message_id": "m2"}, "{broken", {**m, "message_id": "m3", "values": v[2:]}))
    assert rows(d, "message_id", "version", "unavailable_mw") == [("m1", 2, 500.0), ("m2", 2, None), ("m3", 2, None)]


def test_exchange_directions(spark, rows):
    v = [{"start_date": "2026-01-01T00:00:00Z", "end_date": "2026-01-01T00:15:00Z", "value": None}]
    s = lambda a, b: {"sender_country_eic_code": a, "receiver_country_eic_code": b, "updated_date": "2026-01-01T00:00:00Z", "values": v}
    d = records.exchange_schedules(payloads(spark, s("10YFR-RTE------C", "10YES-REE------0"), s("10YCB-GERMANY--8", "10YFR-RTE------C"), s("unknown", "10YFR-RTE------C")))
    assert rows(d, "border", "direction", "value_mw") == [("DE", "import", 0.0), ("ES", "export", 0.0), ("unknown", "import", 0.0)]


def test_arrays_become_hourly_means(spark, rows):
    ok = {"unix_seconds": [0, 900, 3600], "forecast_values": [200, 300, 650], "production_type": "solar"}
    assert rows(records.array_series(payloads(spark, ok), "forecast_values", key="production_type"), "t", "forecast_values") == [(0, 250.0), (3600, 650.0)]
    with pytest.raises(Exception, match="different lengths"):
        records.array_series(payloads(spark, {**ok, "forecast_values": [1]}), "forecast_values").collect()


def test_generation_and_matrix(spark, rows):
    g = {"type": "D-1", "production_type": "SOLAR", "values": [{"start_date": "2026-01-01T00:00:00Z", "updated_date": "2025-12-31T00:00:00Z", "value": x} for x in (1, 4200)]}
    assert rows(records.generation_forecasts(payloads(spark, g, {"type": "D-1"})), "value_mw") == [(4200.0,)]
    m = {"data": {"result": [{"metric": {"pod": "a"}, "values": [[1.5, "2"], [2.5, "NaN"]]}]}}
    assert rows(records.metric_matrix(payloads(spark, m)), "ts", "value") == [(1.5, 2.0), (2.5, None)]


def test_batch_objects(spark, rows):
    job = {"metadata": {"uid": "j", "name": "job"}}
    pod = {"metadata": {"uid": "p", "name": "pod", "ownerReferences": [{"kind": "Job", "uid": "j"}]}, "spec": {"containers": [{"name": "c", "image": "i:1", "env": [{"name": "A", "value": "1"}, {"name": "SECRET"}]}]}, "status": {"phase": "Running", "containerStatuses": [{"name": "c", "imageID": "sha:x", "restartCount": 4}]}}
    pods, jobs = records.batch_objects(payloads(spark, pod, {**pod, "metadata": {"uid": "q", "name": "alone"}})), records.batch_objects(payloads(spark, job))
    assert rows(records.pods_of_jobs(pods, jobs), "uid") == [("p",)]
    p = records.provenance(pods).filter("uid = 'p'").first()
    assert (p.image, p.image_id, p.environment) == ("i:1", "sha:x", {"A": "1"})
    f = records.preflight(pods).first()
    assert (f.pods, f.running, f.crash_loops, f.blockers) == (2, 2, 2, ["alone", "pod"])


def test_files(spark, rows, tmp_path):
    (tmp_path / "2026_01_x.csv").write_text("AreaMapCode\tDateTime(UTC)\tUpdateTime(UTC)\tMW\nFR\t2026-01-01 00:00:00\t2025-12-31 00:00:00\t10\nFR\t2026-01-01 00:15:00\t2025-12-31 01:00:00\t20\nDE\t2026-01-01 00:00:00\t2025-12-31 00:00:00\t99\n")
    assert rows(records.monthly_tsv(spark, str(tmp_path), "x", ["2026_01"], "FR", "MW"), "value") == [(15.0,)]
    sinks.save_csv(spark.createDataFrame([("q", "m", "package", "s", 1.0, 2.0)], "query string, metric string, zone string, series string, ts double, value double"), str(tmp_path / "samples"))
    assert records.metrics_csv(spark, str(tmp_path / "samples"), ["m"]).count() == 1 and records.metrics_csv(spark, str(tmp_path / "samples"), ["n"]).count() == 0
    for run in ("a", "b"):
        (tmp_path / "runs" / run).mkdir(parents=True)
    (tmp_path / "runs/a/result.json").write_text('{"execution": {"runtime_seconds": 5}}')
    assert rows(records.artefacts(spark, str(tmp_path / "runs"), "result.json", {"runtime": "execution.runtime_seconds", "none": "x.y"}), "run_id", "runtime", "none") == [("a", "5", None)]
    s = spark.createDataFrame([("2026-01-01T00:00:00Z", 1.0), ("2026-01-01T05:00:00Z", 2.0)], "timestamp string, v double")
    sinks.save_snapshot(s, str(tmp_path / "snap"))
    assert records.snapshot(spark, str(tmp_path / "snap"), start=1767243600).count() == 1  # from 03:00


def test_checkpoints_resume(spark, rows, tmp_path):
    p = spark.createDataFrame([(0, 1, 5.0), (86400, 1, 6.0)], "origin bigint, horizon int, v double")
    sinks.save_checkpoints(p, str(tmp_path / "c"))
    sinks.save_checkpoints(p.filter("origin = 0").withColumn("v", F.lit(7.0)), str(tmp_path / "c"))
    assert rows(records.completed(spark, str(tmp_path / "c")), "origin", "v") == [(0, 7.0), (86400, 6.0)]
    assert rows(sinks.pending_origins(spark.createDataFrame([(0,), (5,)], "origin bigint"), p), "origin") == [(5,)]


def test_final_reports_are_written_once(spark, rows, tmp_path):
    folder = str(tmp_path / "reports")
    r = lambda final, n: spark.createDataFrame([("j", final, float(n))], "job_uid string, final boolean, finished_at double")
    assert [sinks.save_reports(r(f, n), folder) for f, n in ((False, 1), (True, 2), (True, 3), (False, 4))] == [1, 1, 0, 0]
    assert rows(sinks.read_reports(spark, folder)) == [("j", True, 2.0)]


def test_json_without_nan_and_names(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, float("inf"))], "a int, b double")
    assert {r[0] for r in sinks.safe_json(d).collect()} == {'{"a":1,"b":null}', '{"a":2,"b":null}'}
    n = spark.createDataFrame([("n s", "a/b", "u")], "x string, y string, z string").select(sinks.document_name(F.col("x"), F.col("y"), F.col("z"))).first()[0]
    assert n == "n-s__a-b__u"
    lines = [r[0] for r in sinks.exposition(spark.createDataFrame([("FR", 100, 16.5)], "zone string, t bigint, carbon double"), 200.0).collect()]
    assert 'carbon_intensity_gco2eq_per_kwh{zone="FR"} 16.5' in lines and "carbon_intensity_up 1" in lines


def test_plain_helpers():
    assert [sinks.seconds(x) for x in ("90", "15m", "2h", "1d")] == [90, 900, 7200, 86400]
    assert sinks.render("a ${X}", {"X": "1"}) == "a 1" and sinks.valid_label("a-b.c") and not sinks.valid_label("-a")
    for bad in (lambda: sinks.seconds("x"), lambda: sinks.render("${Y}", {})):
        with pytest.raises(ValueError):
            bad()


# -- remote


def test_halving_and_retries():
    asked = []

    def fetch(a, b):
        asked.append((a, b))
        if b - a > 10_000:
            raise remote.Truncated
        return [{"t": t} for t in range(a, b, 1000)]

    assert [r["t"] for r in remote.halved(fetch, 0, 40_000)] == list(range(0, 40_000, 1000))
    with pytest.raises(RuntimeError):
        list(remote.halved(lambda a, b: [1] * 5, 0, 7200, limit=5))
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return ["ok"]

    assert remote.with_retries(flaky, sleep=waits.append) == ["ok"] and waits == [2, 4]


def test_chunks():
    assert len(remote.year_chunks(1_600_000_000, 1_700_000_000)) == 4
    local = remote.local_day_chunks(1743202800, 1743202800 + 3 * 86400, 1)  # across the spring change
    assert [b - a for a, b in local][:3] == [86400, 82800, 86400]
    url = remote.export_url("http://x", "d", ["a"], 0, 60, "a")
    assert "select=date_heure%2Ca" in url and "IS+NOT+NULL" in url and "1970-01-01T00%3A01%3A00Z" in url


def test_token_is_kept_and_renewed(monkeypatch):
    import io

    monkeypatch.setenv("C_ID", "a"), monkeypatch.setenv("C_SECRET", "b")
    seen = []

    class Answer(io.BytesIO):
        status = 200

    def opener(request):
        seen.append(request.full_url)
        if "token" in request.full_url:
            return Answer(b'{"access_token": "t%d", "expires_in": 3600}' % len(seen))
        if len(seen) == 2:
            raise urllib.error.HTTPError(request.full_url, 401, "", {}, None)
        return Answer(request.headers["Authorization"].encode())

    c = remote.TokenClient("http://token", "C_ID", "C_SECRET", opener)
    assert c.get("http://data") == (200, b"Bearer t3")
    assert c.get("http://data")[1] == b"Bearer t3" and sum("token" in u for u in seen) == 2


def fake_service(options, start, end):
    return [{"date_heure": f"2026-01-01T{h:02d}:00:00Z", "v": h} for h in range(24) if start <= 1767225600 + h * 3600 < end]


def test_records_source(spark, rows):
    remote.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.sparkContext.addPyFile(__file__)
    d = spark.read.format("emberline_records").option("start", 1767225600).option("end", 1767225600 + 86400).option("chunk", "days:1").option("fetch", "test_sources_live:fake_service").load()
    assert d.count() == 24
    assert rows(d.filter("t >= 1767225600 + 79200"), "t") == [(1767225600 + 79200,), (1767225600 + 82800,)]
    o = {"start": "1767225600", "now": str(1767225600 + 7200), "fetch": "test_sources_live:fake_service", "chunk": "days:1"}
    stream = remote.RecordsStream(o)
    first, last = stream.initialOffset(), stream.latestOffset()
    assert last == {"t": 1767225600 + 7200}
    parts = stream.partitions(first, last)
    assert [len(list(stream.read(p))) for p in parts] == [2] and [list(stream.read(p)) for p in stream.partitions(last, last)] == [[]]
    q = spark.readStream.format("emberline_records").options(**o).load().writeStream.format("memory").queryName("polled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("polled").count() == 2


# -- live


def files(spark, df, folder, parts, order):
    """Write slices of a table in order, so that a stream sees them one after another."""
    import os
    import time

    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        name = next(f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (time.time() - 1000 + i * 10,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_hysteresis_stream_equals_batch(spark, rows, tmp_path):
    import random

    rng = random.Random(5)
    d = spark.createDataFrame([("z", i * 3600, float(rng.randint(0, 60))) for i in range(80)] + [("z", 81 * 3600, 99.0)], "zone string, t bigint, v double")
    got = live.drained(live.hysteresis(files(spark, d, tmp_path, 5, "t"), 20.0, 35.0), str(tmp_path / "o"), "append")
    batch = lc.run_spans(lc.hysteresis_runs(d, ["zone"], F.lit(20.0), F.lit(35.0)), ["zone"])
    assert rows(got, "first", "last") == rows(batch, "first", "last")


def test_rates_stream_equals_batch(spark, rows, tmp_path):
    data = [("FR", 0.0, "carbon", 50.0), ("FR", 10.0, "power", 100.0), ("FR", 16.0, "power", 100.0), ("FR", 20.0, "carbon", 20.0), ("FR", 20.0, "power", 100.0), ("FR", 9000.0, "power", 100.0), ("DE", 5.0, "power", 1.0)]
    d = spark.createDataFrame(data, "zone string, ts double, kind string, value double")
    got = rows(live.drained(live.emission_rates(files(spark, d, tmp_path, 3, "ts")), str(tmp_path / "o"), "append"), "zone", "t", "rate")
    one = 100 / 3.6e6
    assert got == [("DE", 0, None), ("FR", 0, 50 * one), ("FR", 15, 20 * one), ("FR", 15, 50 * one), ("FR", 9000, None)]


def test_windows_and_sessions_of_streams(spark, rows, tmp_path):
    from datetime import datetime, timedelta, timezone

    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    d = spark.createDataFrame([("z", t0 + timedelta(minutes=m), float(m)) for m in (0, 10, 50, 70, 200)], "zone string, time timestamp, value double")
    s = files(spark, d, tmp_path, 2, "time")
    assert rows(live.drained(live.hourly_means(s, ["zone"], "time", "value"), str(tmp_path / "a"), "complete"), "value", "n") == [(20.0, 3), (70.0, 1), (200.0, 1)]
    assert rows(live.drained(live.sliding_sums(s, ["zone"], "time", "value", "1 hour", "30 minutes"), str(tmp_path / "b"), "complete"), "value") == [(10.0,), (60.0,), (70.0,), (120.0,), (200.0,), (200.0,)]
    assert rows(live.drained(live.sessions(s, ["zone"], "time", "30 minutes"), str(tmp_path / "c"), "complete"), "n") == [(1,), (2,), (2,)]


def test_late_labels_and_giving_up(spark, rows):
    jobs = spark.createDataFrame([("a", 0.0, True), ("b", 0.0, False), ("c", 9e5, False)], "job string, end double, valid boolean")
    assert rows(live.report_status(jobs, 1e6), "job", "status") == [("a", "final"), ("b", "given_up"), ("c", "provisional")]


def test_observer_is_idempotent(spark, rows, tmp_path):
    d = spark.createDataFrame([("a", True, 1.0), ("b", False, 2.0), ("a", True, 3.0), ("b", True, 4.0)], "job_uid string, final boolean, finished_at double")
    s = files(spark, d, tmp_path, 4, "finished_at")
    for k in (1, 2):  # the second run with a lost checkpoint reads everything again
        live.observe(s, lambda b: b, str(tmp_path / "out"), str(tmp_path / f"ck{k}")).awaitTermination()
    assert rows(sinks.read_reports(spark, str(tmp_path / "out")), "job_uid", "finished_at") == [("a", 1.0), ("b", 4.0)]


def test_reports_become_final_or_are_given_up(spark, tmp_path):
    from datetime import datetime, timezone

    from emberline.streaming import live

    H = 3600
    day = lambda h: datetime.fromtimestamp(1_700_000_000 + h * H, timezone.utc)
    end = 1_700_000_000.0
    steps = [
        [("a", end, day(1), False), ("b", end, day(1), False), ("c", end, day(1), True)],
        [("a", end, day(30), True), ("b", end, day(30), False), ("c", end, day(31), True)],
        [("z", end + 400 * H, day(400), True)],
        [("y", end + 401 * H, day(401), True)],
    ]
    schema = "job string, finished double, seen timestamp, valid boolean"
    got = []
    for i, rows_ in enumerate(steps):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = live.report_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        q = s.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, e: got.extend((r.job, r.status) for r in b.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(got) == [("a", "final"), ("a", "provisional"), ("b", "given_up"), ("b", "provisional"), ("c", "final"), ("y", "final"), ("z", "final")]


def test_late_data_are_dropped_once_a_window_is_out(spark, tmp_path):
    from datetime import datetime, timezone

    from emberline.streaming import live

    at = lambda h, v: ("FR", datetime.fromtimestamp(h * 3600, timezone.utc), float(v))
    schema, got = "zone string, time timestamp, value double", []
    for rows_ in ([at(1.1, 10), at(1.2, 20), at(2.5, 5)], [at(9, 1)], [at(1.5, 1000), at(9.5, 3)], [at(20, 1)]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = live.hourly_means(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["zone"], "time", "value")
        s.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, e: got.extend((r.t, r.value, r.n) for r in b.collect())).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [(3600, 15.0, 2), (7200, 5.0, 1), (32400, 2.0, 2)]


def test_live_series_are_kept_for_a_while(spark):
    from emberline.streaming.live import LiveCarbon, origins_due

    now, calls = [1_000_000_000.0], []

    def load(name):
        def f(*span):
            calls.append(name)
            return spark.createDataFrame([(int(now[0]) - 10, 1.0), (int(now[0]) - 40 * 86400, 2.0)], "t bigint, carbon double")

        return f

    c = LiveCarbon(load("realtime"), load("history"), clock=lambda: now[0])
    assert c.load(int(now[0]) - 100, int(now[0])).count() == 1
    now[0] += 200
    c.load(int(now[0]) - 100, int(now[0]))
    now[0] += 200
    c.load(int(now[0]) - 100, int(now[0]))
    c.load(int(now[0]) - 41 * 86400, int(now[0]))
    assert calls == ["realtime", "realtime", "history"]
    assert origins_due(86_400, 3 * 86_400) == [172_800, 259_200] and origins_due(86_401, 100_000) == []


def test_records_of_a_service_with_tokens(monkeypatch):
    import io
    import json
    import urllib.error

    from emberline.sources import remote

    asked = []

    class Answer(io.BytesIO):
        status = 200

    def opener(request, timeout=None):
        asked.append((request.full_url, request.headers.get("Authorization", "")))
        if "token" in request.full_url:
            return Answer(json.dumps({"access_token": f"t{len(asked)}", "expires_in": 7200}).encode())
        if request.headers["Authorization"] == "Bearer t1":
            raise urllib.error.HTTPError(request.full_url, 401, "no", {}, None)
        return Answer(json.dumps({"messages": [{"id": 1}]}).encode())

    monkeypatch.setenv("AN_ID", "me")
    monkeypatch.setenv("A_SECRET", "word")
    o = {"url": "https://service.example/m?from={start}&to={end}", "token_url": "https://service.example/token", "id_variable": "AN_ID", "secret_variable": "A_SECRET", "field": "messages"}
    monkeypatch.setitem(remote._clients, ("https://service.example/token", "AN_ID", "A_SECRET"), remote.TokenClient("https://service.example/token", "AN_ID", "A_SECRET", opener))
    assert remote.token_api(o, 0, 3600) == [{"id": 1}] == remote.token_api(o, 0, 3600)[:1]
    assert [u.split("?")[0].rsplit("/", 1)[1] for u, _ in asked] == ["token", "m", "token", "m", "m"] and "1970-01-01T01%3A00%3A00Z" in asked[1][0]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from emberline import session

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.local_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077")))
