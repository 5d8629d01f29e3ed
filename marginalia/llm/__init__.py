"""Operators for preparing training data: deduplication, filtering, tokenizing.

Every module holds one operator with a general interface; ``queries`` applies
each of them to the ``documents`` table with production parameters.
"""
