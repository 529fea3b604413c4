"""Baselines: partial least squares, ridge on embeddings, and marginal log-probability scores."""
