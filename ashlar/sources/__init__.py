"""Readers, sinks and the base tables."""
