"""Spark-native operators for weighted survey and panel analytics."""
