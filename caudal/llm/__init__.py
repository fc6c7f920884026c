"""Operators that a training-data pipeline needs, each by one named method. Nothing else in the library imports this folder."""
