"""The same dataflows on unbounded input."""
