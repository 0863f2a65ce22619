"""Schemas, readers, extracts and writers."""
