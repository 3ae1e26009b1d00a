"""Operators for training text: cleaning, duplicates, scores, packing, storage."""
