"""Training-data operators: extraction, deduplication, scanning, tokenising and packing."""
