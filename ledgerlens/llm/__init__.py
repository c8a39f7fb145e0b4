"""Operators for preparing training text: thirteen operators and their registered queries.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
