"""Column functions: seasonal waveforms, insolation, dates and names."""
