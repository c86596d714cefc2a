"""The evidence engine's plans."""
