"""Operators for preparing training text: one module per operator, queries in ``catalog``."""
