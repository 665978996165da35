"""Incremental forms: resumable enrichment and index upkeep as Structured Streaming."""
