"""Readers and writers of text formats and of the binary store file."""
