"""Operators for training text: co-occurrence, packing, mixing, personal data. Nothing outside imports this package."""
