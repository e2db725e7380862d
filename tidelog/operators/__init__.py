"""Change-log operators."""
