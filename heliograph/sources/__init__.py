"""Readers of landed files. Each returns a DataFrame with a declared schema; nothing is inferred."""
