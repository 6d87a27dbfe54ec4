"""Readers, importers and writers."""
