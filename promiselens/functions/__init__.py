"""Column functions: plain expressions over built-in Spark functions, no Python UDFs."""
