"""Operators for text corpora and learned record linkage; nothing else in the library imports this package."""
