"""Column expressions: numbers, places, texts."""
