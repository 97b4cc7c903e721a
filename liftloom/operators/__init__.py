"""Operators of the uplift engine."""
