"""tradeloom: a Spark-native engine for supplier-research data."""
