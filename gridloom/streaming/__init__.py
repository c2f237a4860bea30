"""Structured Streaming over a trained map."""
