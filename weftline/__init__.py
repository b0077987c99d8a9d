"""Retail trend and recommendation analytics as Spark DataFrame operators."""
