"""Model artifacts, and the data that flows through them, as Spark tables and queries."""
