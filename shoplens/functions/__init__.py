"""Column-expression helpers (scalars, vectors) and fixed lookup values."""
