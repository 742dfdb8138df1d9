"""Operators on catalogs, hashes, groups and state tables."""
