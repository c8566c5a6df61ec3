"""Operators that prepare training data: each takes and returns DataFrames.

Nothing outside this subpackage imports it.
"""
