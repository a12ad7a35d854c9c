"""Lines from files, tables and container logs."""
