"""Palimpsest operators."""
