"""loomtrace: Spark-native analytics over AI-assistant conversation traces."""
