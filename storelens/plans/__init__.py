"""The named jobs. Each takes a Store (or another job's output) and returns a DataFrame."""
