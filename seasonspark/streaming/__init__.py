"""Continuous intake of scene tables."""
