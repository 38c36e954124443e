"""Profiling, quality, time, correlation, sampling, chart and exploration operators."""
