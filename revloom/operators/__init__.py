"""Analyses: DataFrame in, DataFrame out, grouped by ``repo``."""
