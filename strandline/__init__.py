"""Spark jobs for paired, timestamped sensor streams."""
