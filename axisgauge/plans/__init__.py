"""Registered queries: fixture views over the given tables, each query with its SQL."""
