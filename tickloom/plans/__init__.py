"""Whole jobs put together from sources and operators."""
