"""Declarative detection rules and training-data operators as Spark DataFrame plans."""

__version__ = "0.1.0"
