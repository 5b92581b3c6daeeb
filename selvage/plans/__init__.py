"""Runs of several stages, and the query catalogue."""
