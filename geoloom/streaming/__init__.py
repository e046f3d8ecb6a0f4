"""The operators on streams."""
