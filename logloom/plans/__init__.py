"""The registered queries and their SQL for DuckDB."""
