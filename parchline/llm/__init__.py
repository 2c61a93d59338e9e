"""Operators on text and records for preparing training data. Nothing else in the library imports this."""
