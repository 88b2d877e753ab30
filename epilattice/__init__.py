"""Spark DataFrame operators for place-by-week panels and origin-destination edges."""

__version__ = "0.1.0"
