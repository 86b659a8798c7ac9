"""Incremental ingestion of test runs."""
