"""A Spark-native engine for judging, filtering, selecting and preparing rows of tables."""
