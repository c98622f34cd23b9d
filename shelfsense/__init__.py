"""Review analytics on Spark: ingest, clean, score, select, route, summarise and measure product reviews."""
