"""Typed-fact queries on Spark."""
