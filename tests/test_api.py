"""Command line, configuration, SQL functions, and the rule that the core doesn't need the llm subpackage."""

import json
import re
from pathlib import Path

import pytest

from emberline import __main__ as cli
from emberline import config
from emberline.functions.sql import register_sql

ROOT = Path(__file__).resolve().parents[1]


def test_configuration(tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"windows": {"quantile": 0.3, "longest": 4.0, "enter_value": None}}))
    c = config.load("w", str(tmp_path))
    assert config.get(c, "windows.quantile") == 0.3 and config.get(c, "a.b", 7) == 7
    assert config.window_parameters(c, most=3) == {"enter_quantile": 0.3, "leave_quantile": 0.3, "longest": 4, "merge_gap": 3600, "most": 3}
    with pytest.raises(FileNotFoundError):
        config.load("x", str(tmp_path))


def test_secret_is_only_named(monkeypatch):
    monkeypatch.delenv("NO_SUCH", raising=False)
    with pytest.raises(RuntimeError, match="NO_SUCH"):
        config.secret("NO_SUCH")


def test_windows_command(spark, tmp_path):
    rows = [(f"2026-01-0{1 + i // 24}T{i % 24:02d}:00:00Z", 10.0 if 30 <= i < 33 else 50.0) for i in range(48)]
    spark.createDataFrame(rows, "timestamp string, carbon_intensity_gco2_kwh double").write.parquet(str(tmp_path / "s"))
    cli.main(["windows", "--input", str(tmp_path / "s"), "--percentile", "0.05", "--output", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).first().hours == 3


def test_sql_functions(spark):
    register_sql(spark)
    r = spark.sql("select fossil_regime(600D), emission_rate(100D, 36D), counter_rise(5D, 9D), counter_rise(NULL, 9D), minmax_score(1D, 1D, 1D), proxy_intensity(60D, 10D, 5D, 3D, 10D, 5D, 5D, 2D)").first()
    assert list(r[:5]) == [1, 0.001, 5.0, None, 0.5] and r[5] == pytest.approx((986 * 5 + 777 * 2 + 429 * 10 + 494 * 5) / 100)


def test_core_does_not_import_the_llm_subpackage():
    for path in [*ROOT.glob("emberline/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != Path(__file__).name:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path


def test_commands_from_files_to_outputs(spark, tmp_path):
    from emberline import __main__ as cli

    H, D = 3600, 86400
    t0 = 1_700_006_400  # midnight
    value = lambda t: 50.0 + (t // H) % 24 + (t // D) % 5
    keys = [(t0 + d * D, h, t0 + d * D + h * H) for d in range(20) for h in range(1, 25)]
    spark.createDataFrame([(o, h, t, value(t) * 1.2, value(t)) for o, h, t in keys], "origin bigint, horizon int, target bigint, prediction_raw double, actual double").write.parquet(f"{tmp_path}/direct")
    spark.createDataFrame([(o, h, t, value(t)) for o, h, t in keys], "origin bigint, horizon int, target bigint, physical double").write.parquet(f"{tmp_path}/physical")
    from datetime import datetime, timezone

    spark.createDataFrame([(datetime.fromtimestamp(t0 + i * H, timezone.utc).isoformat(), value(t0 + i * H)) for i in range(-48, 22 * 24)], "timestamp string, carbon double").write.parquet(f"{tmp_path}/carbon")
    cli.main(["gate", "--direct", f"{tmp_path}/direct", "--physical", f"{tmp_path}/physical", "--carbon", f"{tmp_path}/carbon", "--output", f"{tmp_path}/gate"])
    p = spark.read.parquet(f"{tmp_path}/gate/predictions.parquet")
    m = {r.model: float(r.mape) for r in spark.read.option("header", True).csv(f"{tmp_path}/gate/metrics.csv").collect()}
    assert set(m) == {"raw", "blend", "calibrated_7d", "calibrated_14d"} and p.count() == 4 * len(keys) and m["raw"] < 5
    p.filter("model in ('raw', 'blend')").write.parquet(f"{tmp_path}/runs")
    cli.main(["evaluate", "--predictions", f"{tmp_path}/runs", "--primary", "raw", "--draws", "50", "--output", f"{tmp_path}/windows"])
    assert spark.read.parquet(f"{tmp_path}/windows/catalog.parquet").count() == 2 * 20 * 300
    assert spark.read.text(f"{tmp_path}/windows/report.json").count() == 2
    d = spark.read.parquet(f"{tmp_path}/direct").withColumnRenamed("prediction_raw", "x")
    d.filter(f"origin < {t0 + 18 * D}").write.parquet(f"{tmp_path}/frame")
    cli.main(["refit", "--frame", f"{tmp_path}/frame", "--features", "x", "--output", f"{tmp_path}/refits"])
    assert spark.read.parquet(f"{tmp_path}/refits").filter("prediction is not null").select("origin").distinct().count() == 17
    d.write.mode("overwrite").parquet(f"{tmp_path}/frame")
    cli.main(["refit", "--frame", f"{tmp_path}/frame", "--features", "x", "--output", f"{tmp_path}/refits"])
    assert spark.read.parquet(f"{tmp_path}/refits").count() == 20 * 24
    with pytest.raises(ValueError, match="lacks"):
        cli.main(["evaluate", "--predictions", f"{tmp_path}/frame", "--primary", "raw", "--output", f"{tmp_path}/w2"])
