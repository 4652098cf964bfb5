"""Column expressions over byte strings and numeric series."""
