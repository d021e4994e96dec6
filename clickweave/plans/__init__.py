"""Plan helpers (skew) and whole jobs."""
