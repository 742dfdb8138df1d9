"""Reviewable plans of deletions, moves and renames; nothing is touched."""
