"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface and the thin registered query on top.
"""
