"""Operators of a training-data pipeline: deduplication, filters, mixing, ordering, packing.

Nothing outside this package imports it. Every operator takes DataFrames, keeps
all rows, and stages what it reuses as tables below ``spark.checkpoint.dir``.
"""
