"""Column expressions shared by the jobs: money, text, dates, labels, messages."""
