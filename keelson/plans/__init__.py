"""Whole jobs put together from operators, and the views derived from the test tables."""
