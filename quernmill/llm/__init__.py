"""Operators for preparing language-model training corpora.

Nothing outside this package imports it.  Each module holds one operator and the query that
applies it to its whole table; ``registry`` collects the queries and their SQL.
"""
