"""linkloom: website link-graph analytics expressed as Spark DataFrame jobs."""
