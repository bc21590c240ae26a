"""Column functions and helpers that operators share."""
