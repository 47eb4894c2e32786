"""Palimpsest functions."""
