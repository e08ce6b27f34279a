"""DuckDB statements that state, independently of the Spark code, what each query returns."""
