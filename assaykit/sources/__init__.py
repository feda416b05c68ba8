"""Readers, writers and path parsing."""
