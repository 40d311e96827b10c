"""Row-level provenance for Spark SQL and DataFrame queries, on the public Spark API."""
