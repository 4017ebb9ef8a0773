"""Training-data operators: mixing, fingerprints, packing, near-duplicates, quality, toxicity,
pseudonyms, chat formatting, repeated passages and sharding. Nothing else in the library imports this."""
