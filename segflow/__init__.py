"""Spark-native analytics over labelled time segments, linked questionnaires and cohort tables."""
