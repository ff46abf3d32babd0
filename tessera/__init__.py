"""Spatial copy-number analytics as composable PySpark operators."""
