"""Spark jobs that turn text into triples and graph tables."""
