"""Operators of a training-data pipeline: one module for each, `queries` binds them to the tables."""
