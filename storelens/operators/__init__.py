"""Reusable DataFrame operators: ranking, cleaning, features, metrics, scoring, TF-IDF."""
