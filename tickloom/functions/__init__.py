"""Column functions: fixed-point numbers, name-based ids, clocks, JSON text."""
