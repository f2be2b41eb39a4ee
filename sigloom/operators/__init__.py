"""Operators on tables of samples, markers, windows, predictions and distances."""
