"""Operators on tables by name: comparison, lookup, scans and index reports."""
