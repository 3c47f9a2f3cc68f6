"""Tensor relations built from data, tables and JSON documents."""
