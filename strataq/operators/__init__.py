"""Operators over change logs."""
