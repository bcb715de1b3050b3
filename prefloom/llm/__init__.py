"""Operators of a training-data pipeline: each module holds one, queries.py registers them."""
