"""Gritstone plans."""
