"""Operators for preparing training data.

Nothing else in the library imports this package. Each module holds one operator with its
own interface; ``queries`` applies them to the given tables.
"""
