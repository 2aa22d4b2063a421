"""Operators of a training-data pipeline: extraction, near-duplicates, scoring, tokens, archives."""
