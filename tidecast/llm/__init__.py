"""Operators for preparing training data: archives, tokens, packing, quality, duplicates, leaks, secrets and URLs."""
