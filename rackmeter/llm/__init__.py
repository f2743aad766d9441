"""Operators for building training data from text corpora."""
