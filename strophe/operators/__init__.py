"""Operators over ordered tables."""
