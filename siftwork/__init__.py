"""Security findings over source corpora, as Spark jobs."""
