"""inkframe: typed plain text and corpus preparation as Spark DataFrame operations."""
