"""Operators for preparing training corpora: sharding, mixing, deduplication, filtering, decontamination."""
