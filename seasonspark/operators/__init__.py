"""Operators on gridded seasonal series: masks, cleaning, statistics, fits, frames, orbits."""
