"""Descriptors, tables, result stores and synthetic data."""
