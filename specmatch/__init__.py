"""Cross-study feature matching and corpus preparation on Spark."""
