"""Network-flow analytics, dataset preparation and scoring as Spark jobs."""
