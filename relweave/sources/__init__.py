"""Readers, writers and record loading."""
