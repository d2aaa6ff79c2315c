"""Operators for training-data work over code and text; nothing in the core imports this package."""
