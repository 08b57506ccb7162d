"""Mobility analytics as Spark DataFrame operators."""
