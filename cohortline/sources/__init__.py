"""Reading encounter files and writing tables."""
