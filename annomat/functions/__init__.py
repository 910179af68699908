"""Column functions: saturating casts, index codecs, missing-value policies."""
