"""Operators of a training-data pipeline: search, scoring, filtering, de-duplication, mixing and tokens."""
