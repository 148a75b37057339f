"""Column functions: tolerances, names and codes, text matching. All are built-in expressions, no UDFs."""
