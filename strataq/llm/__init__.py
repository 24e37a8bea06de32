"""Operators for building training corpora at scale.

Every module holds one operator with a general interface and one thin query
that adapts it to the corpus tables. ``queries`` and ``oracle_sql`` collect
them for the repository's entry point.
"""
