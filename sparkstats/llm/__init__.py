"""Operators for preparing language-model training corpora, and their queries.

Nothing else in the library imports this subpackage.
"""
