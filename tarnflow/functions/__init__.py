"""Column expressions and the few Arrow functions that no built-in expresses."""
