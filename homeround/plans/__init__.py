"""Plans of the visit-planning library."""
