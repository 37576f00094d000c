"""Operators for preparing training data, and their queries.

Nothing outside this subpackage imports it.
"""
