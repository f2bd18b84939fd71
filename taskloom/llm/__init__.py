"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` holds the thin queries that the
entry file registers.
"""
