"""Operators for preparing training corpora: deduplication, extraction, quality, mixing, tokens, search."""
