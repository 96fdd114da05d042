"""Operators for training data: near-duplicates, survivors, matching, leakage, mixing, reading level."""
