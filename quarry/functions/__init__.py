"""Expressions whose meaning differs from Spark's default."""
