"""Training-data operators: fingerprints, language, secrets, BPE, mixing, scoring, dedup, URL rules."""
