"""Time-series market analytics and data maintenance as Spark DataFrame jobs."""
