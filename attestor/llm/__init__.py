"""Training-data operators: filtering, deduplication, extraction, tokens, packing, search."""
