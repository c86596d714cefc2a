"""The evidence engine's functions."""
