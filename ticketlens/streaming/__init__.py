"""Structured Streaming re-aims of the reference's request/response paths."""
