"""Corpus operators for training data: ten operators, their queries and their SQL.

Nothing else in the package imports this subpackage.
"""
