"""Training-data operators (WARC, dedup, quality, tokens, HTML, sharding, PII, mixing, fingerprints)."""
