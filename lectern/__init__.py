"""Lectern: corpus analytics as Spark DataFrame operators."""
