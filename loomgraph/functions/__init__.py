"""Column expressions over text, JSON and vectors."""
