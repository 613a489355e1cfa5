"""fieldweave: schema mapping, document extraction and feedback analytics as Spark jobs."""
