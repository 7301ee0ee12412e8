"""Incremental runs as Structured Streaming queries: each takes a folder of new rows and a checkpoint, does what is new, and ends or goes on."""
