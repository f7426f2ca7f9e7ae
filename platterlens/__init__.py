"""Spark-native analytics for media-disc archives: identification, verification, recognition, rescue and reporting."""
