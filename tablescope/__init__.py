"""Profiling and exploration of tabular data as plain DataFrame-to-DataFrame functions on Spark."""
