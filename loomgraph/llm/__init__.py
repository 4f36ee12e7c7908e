"""Operators of large-scale training-data pipelines.

Nothing else in the package imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold what the entry module registers.
"""
