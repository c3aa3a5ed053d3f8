"""Operators of a training-data pipeline, written as Spark jobs.

Each module holds one operator with a general interface; ``queries`` registers the thin ``opN_*`` queries over the test tables.
"""
