"""Weights, lags, Moran statistics, permutation inference and multiple testing."""
