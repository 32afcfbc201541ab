"""Column functions: cleaning, extraction, identity."""
