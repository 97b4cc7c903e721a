"""Functions of the uplift engine."""
