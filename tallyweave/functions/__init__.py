"""Columns as functions, and the contract of the feature table."""
