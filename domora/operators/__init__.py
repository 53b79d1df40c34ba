"""Operators of the listing engine."""
