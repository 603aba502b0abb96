"""Change-impact and document analytics as Spark DataFrame jobs."""
