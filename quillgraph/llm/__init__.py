"""Operators for building training corpora from document tables.

Nothing outside this folder imports it.  ``registry`` lists the queries.
"""
