"""Column builders. Nothing in here runs Python per row."""
