"""Column functions: text tests and counts, path parts, deterministic hashing."""
