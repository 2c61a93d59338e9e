"""Model."""
