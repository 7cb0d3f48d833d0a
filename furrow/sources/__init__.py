"""Table readers, writers and the stage tables that cut long lineages."""
