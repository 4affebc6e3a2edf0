"""corpusloom: a Spark-native corpus processing, retrieval and analytics engine."""
