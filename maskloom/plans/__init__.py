"""Query catalog (one entry per SURVEY §2 operator) and driver loops."""
