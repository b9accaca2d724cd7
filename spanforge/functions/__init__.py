"""Column expressions over byte strings."""
