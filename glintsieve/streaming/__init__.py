"""The same plans on streams of lines."""
