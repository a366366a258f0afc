"""Data-quality profiling, duplicate detection and name cleaning as Spark DataFrame operators."""
