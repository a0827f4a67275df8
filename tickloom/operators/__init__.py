"""Operators over tick tables."""
