"""Gritstone streaming."""
