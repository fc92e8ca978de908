"""Operators of a training-data pipeline: scoring, near-duplicate removal, rules, mixing and packing of documents."""
