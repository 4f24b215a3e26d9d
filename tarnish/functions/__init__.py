"""Column expressions and per-batch kernels."""
