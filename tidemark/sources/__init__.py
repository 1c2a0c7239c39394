"""Readers, writers and the table layout."""
