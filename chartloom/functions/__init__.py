"""Column functions: scores, text, privacy, rules."""
