"""Operators for preparing training text: ten jobs over documents and conversations. Nothing outside imports this package."""
