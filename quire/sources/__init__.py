"""Readers, writers and import decisions."""
