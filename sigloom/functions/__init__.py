"""Numerical helpers that know nothing of Spark, and their column forms."""
