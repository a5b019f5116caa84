"""Column expressions: index and score ranges, globs, geohashes, hash slots, scripts."""
