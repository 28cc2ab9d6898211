"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage. Each module holds one
operator and its registered query; ``registry`` collects queries and SQL.
"""
