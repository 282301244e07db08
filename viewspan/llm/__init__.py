"""Training-data operators: one module for each, plus shared helpers.

Nothing outside this subpackage imports it.
"""
