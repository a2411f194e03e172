"""Operators of a large-scale training-data pipeline.

Self-contained: nothing else in the library imports this subpackage. Each
module holds one operator with its own interface; ``queries`` binds them to
the driver's tables.
"""
