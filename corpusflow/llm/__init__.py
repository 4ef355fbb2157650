"""Operators for preparing training data: mixing, classifiers, duplicates, archives, pieces, search."""
