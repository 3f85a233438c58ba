"""Views over tables and named queries."""
