"""Word-embedding analytics on Spark."""
