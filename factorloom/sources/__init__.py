"""Readers, writers, fingerprints, and bindings of the test tables to panel shapes."""
