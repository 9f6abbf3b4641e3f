"""Gritstone functions."""
