"""brambling: knowledge-base and event-log analytics expressed as PySpark plans."""
