"""Operators over text and code for training data. Nothing outside this package imports it."""
