"""Structured Streaming twins of the waveform operators."""
