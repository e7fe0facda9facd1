"""barloom: market-bar analytics expressed as Spark DataFrame jobs."""
