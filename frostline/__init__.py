"""Cold-chain telemetry analytics written as Spark DataFrame operators."""
