"""Streams as tables: what the SQL engine does not need, Structured Streaming gives."""
