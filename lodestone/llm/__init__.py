"""Operators for large text corpora that feed model training.

Nothing else in the package imports this subpackage; it can be removed
without affecting the retrieval engine.
"""
