"""Operators that prepare text for model training. Nothing outside imports this package."""
