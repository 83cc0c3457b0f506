"""Whole evaluations: summaries and reports."""
