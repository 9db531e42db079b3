"""Payment-dispute risk analytics as Spark DataFrame, ML and streaming jobs."""
