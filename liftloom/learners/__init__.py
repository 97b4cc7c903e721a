"""Base learners, cross-fitting and meta-learners."""
