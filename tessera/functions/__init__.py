"""Column functions, wire kernels and dimension tables."""
