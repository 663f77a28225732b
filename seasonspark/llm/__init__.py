"""Operators for building language-model training corpora.

Nothing outside this package imports it; ``queries`` holds the registered queries.
"""
