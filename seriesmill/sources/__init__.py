"""Typed scans, checks on what was read, and sinks."""
