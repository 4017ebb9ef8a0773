"""A Spark-native narrative-analytics engine: text to annotations to graph to queries."""

__version__ = "0.1.0"
