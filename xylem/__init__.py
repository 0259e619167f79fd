"""Spark-native analytics over collections of XML documents."""
