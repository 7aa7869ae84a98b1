"""marlstone: a Spark-native discovery and data-processing engine."""
