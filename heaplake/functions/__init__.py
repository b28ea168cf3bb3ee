"""Column functions and the fixed value tables of the dump format."""
