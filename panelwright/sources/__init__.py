"""Readers, writers and metadata tables."""
