"""Reading tables and keeping models."""
