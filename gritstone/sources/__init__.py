"""Gritstone sources."""
