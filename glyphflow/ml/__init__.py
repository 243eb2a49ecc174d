"""Learned ordering and pruning: features, scores, training."""
