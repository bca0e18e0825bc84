"""Column functions: keys, numbers, calendar days, guarded arithmetic."""
