"""Gritstone operators."""
