"""Operators that prepare corpora for the training of language models.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
thin queries that apply each operator to its table.
"""
