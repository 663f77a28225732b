"""Scans and sinks: scenes, stacks, parameter cubes, orbital tables, listings."""
