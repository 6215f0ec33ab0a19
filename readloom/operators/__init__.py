"""Operators over alignments: the store, interval joins and the three query modes."""
