"""Structured Streaming variants: the same mergeable sums over unbounded input. An extension of this engine."""
