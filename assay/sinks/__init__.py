"""Sinks: DataFrames to files and tables of text."""
