"""emberline: carbon-aware time-series analytics as composable PySpark DataFrame operators."""
