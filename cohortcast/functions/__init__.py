"""Column functions: normalisers of prices, distances, times and names."""
