"""Operators of a training-data pipeline: fingerprints, filters, search, mixing and packing."""
