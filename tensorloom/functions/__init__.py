"""Semirings as Column builders."""
