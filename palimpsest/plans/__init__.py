"""Palimpsest plans."""
