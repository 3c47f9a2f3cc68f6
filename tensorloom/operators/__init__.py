"""Unary, binary and n-ary contraction operators and their gradients."""
