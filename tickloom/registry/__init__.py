"""Registered queries and the SQL that checks them, over the given tables."""
