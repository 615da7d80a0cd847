"""Training-data operators: deduplication, mixing, storage, search, fingerprints, sharding, packing, extraction, toxicity."""
