"""Incremental ingestion with Structured Streaming: an extension, the batch operators don't need it."""
