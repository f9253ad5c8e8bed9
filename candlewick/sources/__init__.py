"""Readers: bar files, ticks, run artifacts, run logs."""
