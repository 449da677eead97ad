"""Cairnlight: source-code analytics as declarative Spark plans."""
