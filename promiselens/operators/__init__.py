"""Reusable DataFrame operators: joins that survive skew, ranking, calendars, checks."""
