"""Structured Streaming: incremental, resumable batch scoring."""
