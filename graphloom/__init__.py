"""graphloom: a Spark-native engine for code-graph analytics and text search."""
