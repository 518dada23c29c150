"""Structured Streaming forms of the relation operators (an extension)."""
