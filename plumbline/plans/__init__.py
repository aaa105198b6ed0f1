"""Registered queries: each operator applied to the driver tables, with its DuckDB counterpart."""
