"""Readers, writers and the store of finished runs."""
