"""Operators of Q-methodology studies as DataFrame expressions."""
