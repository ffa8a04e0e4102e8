"""Readers, writers and the adapter from the star-schema test tables."""
