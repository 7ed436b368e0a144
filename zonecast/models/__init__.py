"""Regressors and classifiers on feature tables."""
