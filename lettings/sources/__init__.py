"""Readers, lineage, writers and table listings."""
