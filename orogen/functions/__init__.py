"""Column functions and small solvers."""
