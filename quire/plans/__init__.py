"""Queries over the driver's tables, with SQL that says the same."""
