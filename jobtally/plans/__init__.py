"""Whole analyses: from job records (and catalogue tables) to a result table."""
