"""Readers and writers of telemetry files."""
