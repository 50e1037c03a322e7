"""Spark-native analytics for time-ordered acoustic and posture measurements."""
