"""Spark-native document layout engine: tables of frames, boxes, words and lines."""
