"""Operators a training-data pipeline needs; nothing else in the package imports this folder."""
