"""Readers, folder inventory and sinks."""
