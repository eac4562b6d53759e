"""Anomaly detectors: fit on DataFrames, score as columns."""
