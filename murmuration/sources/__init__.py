"""Readers, writers, simulators, and particle views of tables."""
