"""Tables on storage."""
