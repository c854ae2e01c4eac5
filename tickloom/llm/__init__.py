"""Operators for preparing training text, with their queries. Nothing else in the package imports this folder."""
