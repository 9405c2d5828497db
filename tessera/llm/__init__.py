"""Operators for large text and code collections that become training data."""
