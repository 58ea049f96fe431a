"""Incremental forms of the jobs, as Structured Streaming queries."""
