"""Streaming use of the per-row text operators."""
