"""Structured Streaming forms of the incremental views. An extension: the batch operators are the reference semantics."""
