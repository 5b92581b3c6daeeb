"""Listing, reading and parsing of sources."""
