"""Reports written to folders."""
