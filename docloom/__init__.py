"""Spark-native document-to-Markdown engine: files and pages are rows, heuristics are columns."""
