"""Scalar functions over text, identifiers and boxes."""
