"""Operators on DataFrames: gates, joins, scoring, merges, reports, page and robots jobs."""
