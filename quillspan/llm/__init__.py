"""Training-data operators: sharding, PII, quality, toxicity, deduplication, secrets, packing, token counts and decontamination."""
