"""A Spark engine for event-centric memory-benchmark data."""
