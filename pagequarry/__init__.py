"""Spark-native document-layout analytics and corpus preparation."""
