"""Stateless and windowed operators on streams."""
