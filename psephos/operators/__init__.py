"""psephos: election-count analytics as Spark jobs."""
