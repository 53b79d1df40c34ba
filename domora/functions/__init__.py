"""Functions of the listing engine."""
