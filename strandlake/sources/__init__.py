"""Readers and writers of genomic formats."""
