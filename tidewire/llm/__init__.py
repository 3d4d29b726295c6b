"""Operators of a training-data pipeline: scoring, filtering, deduplication, mixing, media and tokenisation."""
