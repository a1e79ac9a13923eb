"""Table definitions and where tables are kept."""
