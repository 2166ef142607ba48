"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` binds them to the tables.
"""
