"""Where tables are: a versioned Parquet store, and readers and writers of other forms."""
