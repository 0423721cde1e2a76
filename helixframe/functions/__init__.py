"""Column functions on bases, packed identifiers and qualities."""
