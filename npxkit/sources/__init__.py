"""Readers, writers and the fixture views over the test tables."""
