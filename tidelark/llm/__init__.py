"""Operators for large-scale training-data pipelines.

Each module holds one operator with its own general interface; `registry`
turns them into the queries of the driver's contract. Nothing outside this
subpackage imports it.
"""
