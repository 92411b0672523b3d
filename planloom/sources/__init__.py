"""Readers, sinks and staged intermediate tables."""
