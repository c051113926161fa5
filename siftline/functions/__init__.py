"""Column functions: cleaning, extraction, times, URLs and rule classification. All are built from Spark's own functions."""
