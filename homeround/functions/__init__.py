"""Functions of the visit-planning library."""
