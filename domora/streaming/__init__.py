"""Streaming of the listing engine."""
