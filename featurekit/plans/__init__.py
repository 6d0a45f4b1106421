"""Operator names and file-to-file tasks."""
