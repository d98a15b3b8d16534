"""Relational operators on bindings of variables."""
