"""Tidelark: windowed multi-channel time-series analytics on PySpark."""
