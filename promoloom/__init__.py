"""Retail promotion analytics as Spark DataFrame operators."""
