"""Operators: spans, intervals, checks, rollups, reports."""
