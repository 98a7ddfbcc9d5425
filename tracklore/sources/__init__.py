"""Readers for raw exports and reference dumps."""
