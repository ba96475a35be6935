"""Spark-native interactive search, validation, layout and session-stream operators."""
