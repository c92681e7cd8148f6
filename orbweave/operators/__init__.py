"""Weights, estimators, synthesis, spectra and series as DataFrame transformations."""
