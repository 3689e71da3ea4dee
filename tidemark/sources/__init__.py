"""Readers and writers for the table contracts."""
