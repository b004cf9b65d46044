"""Operators for building training data out of large text corpora.

Nothing else in the library imports this subpackage; it can be removed without
touching the remaining operators.
"""
