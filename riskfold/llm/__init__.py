"""Operators for building training corpora: scoring, deduplication, search,
tokenisation and packing, each over whole Spark tables.

Nothing outside this package imports it; the queries are registered by
``__spark_entry__.py`` when the package is present.
"""
