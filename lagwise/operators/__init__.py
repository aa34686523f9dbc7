"""DataFrame operators. Table and column names are always parameters."""
