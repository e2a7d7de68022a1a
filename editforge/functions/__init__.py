"""Column-level (scalar) functions, all built from ``pyspark.sql.functions``."""
