"""Document-graph analytics as Spark jobs."""
