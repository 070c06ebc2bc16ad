"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; it imports nothing from the rest
of the library, so either half can be removed without the other noticing.
"""
