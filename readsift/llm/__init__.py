"""Operators of a training-data pipeline. Nothing else in readsift imports this package."""
