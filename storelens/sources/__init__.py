"""Readers and writers: the store's tables, models, call lists and logs."""
