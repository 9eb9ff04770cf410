"""Scalar functions of text, numbers, dates and places."""
