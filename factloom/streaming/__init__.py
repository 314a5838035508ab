"""Keyed streaming state: documents by version, sample windows, refresh requests."""
