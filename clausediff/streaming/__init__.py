"""Comparisons of documents as they arrive."""
