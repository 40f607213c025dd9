"""Operators for training data: deduplication, token counts, packing, archives, filters."""
