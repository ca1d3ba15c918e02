"""Operators for training data. Nothing else in the engine imports this package."""
