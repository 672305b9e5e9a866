"""Compositions of operators: feature sets, prepared datasets, experiments."""
