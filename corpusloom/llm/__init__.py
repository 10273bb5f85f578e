"""Operators of a training-data pipeline: filters, deduplication, decontamination, tokenization."""
