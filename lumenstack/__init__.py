"""Spark-native engine for stacks of image frames held as pixel tables."""
