"""Operators of a large training-data pipeline, each one a Spark job.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries and their SQL; every other module is one operator with a general
interface, plus the thin ``opN_<name>`` query that applies it to a whole table.
"""
