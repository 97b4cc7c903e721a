"""Plans of the uplift engine."""
