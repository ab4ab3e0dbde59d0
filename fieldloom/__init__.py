"""fieldloom: device telemetry normalisation as Spark jobs."""
