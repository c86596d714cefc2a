"""The evidence engine's sources."""
