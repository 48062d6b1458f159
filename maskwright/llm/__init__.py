"""Operators for the preparation of training text: one module per operator, queries in ``queries.py``."""
