"""The operators bound to the parquet tables of a data directory, with SQL equivalents."""
