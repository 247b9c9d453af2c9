"""Whole computations: calibration, comparison, scoring."""
