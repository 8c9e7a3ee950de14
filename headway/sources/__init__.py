"""Readers and writers over landed files."""
