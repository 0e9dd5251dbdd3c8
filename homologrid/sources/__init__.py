"""Readers and writers for the text formats of the analysis."""
