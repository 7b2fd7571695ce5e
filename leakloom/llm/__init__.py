"""Operators of a large-scale training-data pipeline, by their own methods.

Nothing outside this subpackage imports it.
"""
