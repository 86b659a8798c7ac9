"""Training-data operators: personal data, media, decontamination, language models, deduplication, mixing, sharding."""
