"""Operators of a training-data pipeline: counts, filters, near copies, scans, packing."""
