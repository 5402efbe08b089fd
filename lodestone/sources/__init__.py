"""Readers and converters of files."""
