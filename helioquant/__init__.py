"""Plant-telemetry quality and energy analytics as lazy Spark DataFrame operators."""
