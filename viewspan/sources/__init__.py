"""Readers of Q-sort file formats and writers of result tables."""
