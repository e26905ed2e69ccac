"""Ingest, validation and incremental load of operational files with Spark DataFrames."""
