"""Operators for large text corpora and identifier sets."""
