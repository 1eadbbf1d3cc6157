"""Reading raw files and keeping tables."""
