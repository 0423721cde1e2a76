"""Relational operators of the spectrum and correction engine."""
