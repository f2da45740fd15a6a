"""ferrule: Spark-native analytics over program-analysis tables."""
