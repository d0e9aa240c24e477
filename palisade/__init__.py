"""Palisade: security-log normalisation and analytics as Spark DataFrame operators."""
