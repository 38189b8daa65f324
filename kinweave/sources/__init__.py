"""Readers and writers of every input and output format."""
