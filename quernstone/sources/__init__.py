"""Readers that keep rejected rows, and writers that keep their counts."""
