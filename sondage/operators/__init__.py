"""Matching, evaluation, catalog, verification and graph operators."""
