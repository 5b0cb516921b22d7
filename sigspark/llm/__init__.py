"""Operators for preparing language-model training data, and their queries.

Nothing else in the library imports this package. Each module holds one operator
with its own general interface; ``queries`` registers the thin ``opN_`` queries.
"""
