"""Specifications, parsers and contraction orders."""
