"""Tidemark: keyed time-series analytics and corpus operations on PySpark."""
