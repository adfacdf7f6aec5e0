"""Queries over the test tables, and the whole register put together from the operators."""
