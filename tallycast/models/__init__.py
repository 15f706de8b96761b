"""Pooled models, fitted as Spark jobs over the training matrix."""
