"""Checks of the library on the given test tables: bindings, queries, oracle SQL."""
