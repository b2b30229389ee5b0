"""Operators for building training data: text cleaning, duplicates, mixing and tokens."""
