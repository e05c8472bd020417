"""Readers of netlists, delay files, waveforms and logs. Schemas are declared, never inferred."""
