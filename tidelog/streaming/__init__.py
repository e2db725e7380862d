"""Change-log streaming."""
