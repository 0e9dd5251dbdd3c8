"""Resumable, incremental ingestion."""
