"""Sources of graph deltas."""
