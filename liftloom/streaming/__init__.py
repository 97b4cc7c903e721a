"""Structured Streaming over fitted models and policies."""
