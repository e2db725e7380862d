"""Change-log plans."""
