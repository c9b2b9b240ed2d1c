"""Operators for preparing training text: one module per operator, `entries.py` lists their queries."""
