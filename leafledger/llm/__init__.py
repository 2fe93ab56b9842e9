"""Operators for training text; nothing outside this folder imports it."""
