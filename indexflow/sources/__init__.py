"""Keyed, versioned sources."""
