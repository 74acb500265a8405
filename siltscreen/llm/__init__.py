"""Training-data operators: quality, toxicity, near duplicates, decontamination, tokens, sharding."""
