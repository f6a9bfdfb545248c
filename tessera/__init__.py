"""Tessera: device telemetry, raw sensor frames and record wire formats as Spark jobs."""
