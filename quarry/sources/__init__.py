"""Tables: the versioned Parquet store, its catalog, SQL scripts and result export."""
