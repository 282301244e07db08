"""Structured Streaming of arriving sorts."""
