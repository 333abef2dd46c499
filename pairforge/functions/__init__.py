"""Column functions and deterministic randomness."""
