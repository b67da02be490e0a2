"""Column expressions (scalar functions F1-F12, hash order, Yeo-Johnson)."""
