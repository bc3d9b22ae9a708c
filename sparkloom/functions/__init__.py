"""Column functions over JSON values, calls and outcomes."""
