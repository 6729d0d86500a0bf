"""Fidelis: a PySpark-native engine for auditing model faithfulness and building corpora."""

__version__ = "0.1.0"
