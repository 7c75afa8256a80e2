"""Streaming ingestion of field tables."""

from .ingest import daily_counts, start

__all__ = ["daily_counts", "start"]
