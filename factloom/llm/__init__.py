"""Operators of a training-data pipeline: ten cleaning and encoding steps over text tables."""
