"""Domain tables from stored tables and files."""
