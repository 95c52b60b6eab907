"""A Spark-native engine for memory data: hybrid retrieval, scoring, consolidation, temporal graphs and streams."""
