"""Table schemas, readers, writers and the adapter for the test tables."""
