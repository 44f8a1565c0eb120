"""Reference SQL for the checks: the same results, written for DuckDB on the same tables."""
