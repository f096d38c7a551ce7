"""Operators for preparing training data: sharding, WARC, deduplication, decontamination, tokens, classifiers."""
