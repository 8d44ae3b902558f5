"""Operators that prepare training data, each a DataFrame function with parameters.

Nothing outside this package imports it.
"""
