"""Typed values, and their columns."""
