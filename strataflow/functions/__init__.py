"""Column expressions over ordered groups."""
