"""Operators of a training-data pipeline: sharding, packing, deduplication, decontamination, tokenised output."""
