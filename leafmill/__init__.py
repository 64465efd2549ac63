"""Document analytics on Spark: PDF bytes as tables, and tables as PDF bytes."""
