"""Palimpsest streaming."""
