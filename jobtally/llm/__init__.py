"""Operators for training-data pipelines: language, quality, toxicity, tokens, duplicates, mixing, search, fingerprints."""
