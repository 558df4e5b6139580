"""Evidence analytics on Spark: search, links, threads, coverage and evidence graphs as DataFrame jobs."""
