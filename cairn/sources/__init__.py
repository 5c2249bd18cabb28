"""Scans, sinks and integrity checks of files."""
