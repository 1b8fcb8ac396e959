"""Operators that prepare the archive's texts as training data. Nothing outside imports this package."""
