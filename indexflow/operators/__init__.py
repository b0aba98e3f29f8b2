"""Relational building blocks: nesting, change detection, merging, vector search, graphs."""
