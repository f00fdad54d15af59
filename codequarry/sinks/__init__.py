"""Reports and tables that scans write."""
