"""Palimpsest sources."""
