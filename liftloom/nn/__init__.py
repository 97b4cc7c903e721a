"""Neural uplift models on a small reverse-mode differentiation tape."""
