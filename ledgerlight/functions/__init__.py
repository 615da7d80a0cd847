"""Column functions and driver-side formulas."""
