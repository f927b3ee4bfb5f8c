"""Queries put together from the operators."""
