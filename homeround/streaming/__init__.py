"""Streaming of the visit-planning library."""
