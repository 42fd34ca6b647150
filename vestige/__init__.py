"""Provenance analytics over host event logs, expressed as Spark jobs."""
