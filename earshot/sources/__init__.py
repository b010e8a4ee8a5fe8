"""Readers, writers and views over stored tables."""
