"""Training-data operators: deduplication, filtering, mixing, packing, search and sharding of text corpora."""
