"""Jobs that run from files to files."""
