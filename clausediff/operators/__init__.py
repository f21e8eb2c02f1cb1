"""Relational operators of a comparison: parse, match, align, classify, count, render."""
