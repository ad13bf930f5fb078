"""Registered queries and the adapters from the given tables."""
