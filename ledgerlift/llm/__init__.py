"""Operators for preparing training data: quality, near copies, leaks, mixing, tokens, scores."""
