"""Contract-driven rollup views over event telemetry, on Spark."""
