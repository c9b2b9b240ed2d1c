"""DuckDB statements that state each job's result a second time, independently of Spark."""
