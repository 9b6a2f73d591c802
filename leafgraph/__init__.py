"""leafgraph: web corpus building, vector retrieval and answer contexts as Spark jobs."""
