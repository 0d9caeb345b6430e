"""Operators of the visit-planning library."""
