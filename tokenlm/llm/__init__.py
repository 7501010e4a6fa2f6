"""Operators of a training-data pipeline: filtering, deduplication, cleaning, tokenising and packing of text."""
