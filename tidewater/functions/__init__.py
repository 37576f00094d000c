"""Column expressions that need no user function."""
