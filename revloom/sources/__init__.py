"""Readers and writers: history dumps, Parquet tables, JSON documents, CSV."""
