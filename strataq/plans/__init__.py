"""Query descriptions."""
