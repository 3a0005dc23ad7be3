"""Readers and validation of finder responses."""
