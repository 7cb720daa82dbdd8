"""Readers: job records by day folder, catalogue dumps, lookup tables."""
