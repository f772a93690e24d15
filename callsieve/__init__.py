"""Transcript quality, features, streams and verdict evaluation on Spark."""
