"""Readers, sinks and the stored records of the project's tables."""
