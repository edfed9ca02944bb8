"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface (texts, spans, files); ``queries`` holds the
thin registered queries that derive their columns from those operators.
"""
