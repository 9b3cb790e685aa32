"""Column functions: masking, levels, formats."""
