"""Change-log functions."""
