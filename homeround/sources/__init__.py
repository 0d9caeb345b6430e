"""Sources of the visit-planning library."""
