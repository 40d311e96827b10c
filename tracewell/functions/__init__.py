"""Functions over blocks."""
