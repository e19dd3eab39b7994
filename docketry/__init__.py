"""docketry: a Spark-native evidence and corpus engine."""
