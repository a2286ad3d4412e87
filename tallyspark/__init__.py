"""Spark-native analytics for labelled short text, receipts and spending records."""
