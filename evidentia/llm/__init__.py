"""Operators of a training-data pipeline: quality, decontamination, packing, near-duplicates,
line dedup, toxicity, chat formatting, language ID, secret scans and substring dedup."""
