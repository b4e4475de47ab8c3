"""Column functions that several jobs share."""
