"""Panels over the driver's tables, the registered queries and their DuckDB equivalents."""
