"""Column functions: addresses, texts, formats."""
