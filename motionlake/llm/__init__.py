"""Operators for training-data text: extraction, archives, tokens, deduplication, decontamination, quality."""
