"""Registered queries with their DuckDB equivalents."""
