"""The evidence engine's streaming."""
