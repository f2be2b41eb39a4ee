"""Registered queries: each reads the given tables, or rows that Spark derives from them."""
