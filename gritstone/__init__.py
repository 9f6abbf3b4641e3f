"""Gritstone: a Spark-first analytics engine for design sources, documents and claims."""
