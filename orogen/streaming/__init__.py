"""Incremental forms of additive operators."""
