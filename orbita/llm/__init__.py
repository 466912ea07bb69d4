"""Training-data operators: tokenizing, scoring, extraction, deduplication, packing."""
