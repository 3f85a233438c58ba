"""Column functions and the filter language."""
