"""Structured Streaming live mode."""
