"""Spark-native document-to-speech preparation."""
