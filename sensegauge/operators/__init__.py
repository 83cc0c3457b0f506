"""Operators on tables of pairs, scores and runs."""
