"""Streamed contraction against static operands."""
