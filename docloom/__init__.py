"""docloom: Spark-native analytics for evidence-grounded document review."""
