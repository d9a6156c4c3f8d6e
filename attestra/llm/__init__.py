"""Operators that prepare text and records for training sets. Nothing else in the package imports this."""
