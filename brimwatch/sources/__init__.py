"""Table scans, sinks and the mapping of sample tables to the fleet model."""
