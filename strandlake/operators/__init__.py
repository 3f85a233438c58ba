"""Relational operators over reads, variants and intervals."""
