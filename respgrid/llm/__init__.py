"""Training-data operators: packing, counting, extraction, filtering, deduplication, mixing, scoring."""
