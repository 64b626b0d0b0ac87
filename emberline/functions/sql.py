"""SQL functions and views of the library for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.series import EMISSION, GAS_ON, GAS_PEAK, PARTS

#: Temporary SQL functions; expressions only, so Catalyst inlines and optimises them.
FUNCTIONS = {
    "proxy_intensity": (
        ", ".join(f"{p} DOUBLE" for p in PARTS),
        "DOUBLE",
        f"CASE WHEN {' AND '.join(f'{p} IS NOT NULL' for p in PARTS)} AND {' + '.join(f'greatest({p}, 0D)' for p in PARTS)} > 0 THEN ({' + '.join(f'{f}D * greatest({p}, 0D)' for p, f in EMISSION.items())}) / ({' + '.join(f'greatest({p}, 0D)' for p in PARTS)}) END",
    ),
    "fossil_regime": ("gas DOUBLE", "INT", f"CASE WHEN gas >= {GAS_PEAK}D THEN 2 WHEN gas >= {GAS_ON}D THEN 1 WHEN gas IS NOT NULL THEN 0 END"),
    "emission_rate": ("watts DOUBLE, intensity DOUBLE", "DOUBLE", "watts * intensity / 3.6e6D"),
    "counter_rise": ("current DOUBLE, previous DOUBLE", "DOUBLE", "CASE WHEN current >= previous THEN current - previous WHEN current IS NOT NULL AND previous IS NOT NULL THEN greatest(current, 0D) END"),
    "minmax_score": ("v DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN high - low < 1e-9D THEN 0.5D ELSE 1D - (v - low) / (high - low) END"),
}


def register_sql(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Register the functions, and with a data folder a view per table in it."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    if sf_dir:
        from ..adapters import carbon_hourly, counter_samples, messages, mix_hourly, predictions

        for view in (carbon_hourly, mix_hourly, counter_samples, messages, predictions):
            view(spark, sf_dir).createOrReplaceTempView(view.__name__)
