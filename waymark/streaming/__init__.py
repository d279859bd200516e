"""Structured Streaming forms of request assignment, find-or-insert and demand."""
