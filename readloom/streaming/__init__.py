"""Alignment text as a stream."""
