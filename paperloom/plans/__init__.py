"""Whole plans, and the named queries with their DuckDB counterparts."""
