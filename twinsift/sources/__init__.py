"""Readers of files, archives and pixels, and writers."""
