"""Whole flows composed of operators."""
