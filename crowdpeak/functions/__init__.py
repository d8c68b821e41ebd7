"""Column expressions: numbers, text, emotion rules."""
