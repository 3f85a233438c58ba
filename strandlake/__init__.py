"""strandlake: a PySpark-native engine for genomic record data."""
