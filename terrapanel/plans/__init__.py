"""Data products: each builder is made of the operators and returns a DataFrame."""
