"""nodelake: structured scientific data as DataFrames (catalog, arrays, tables, runs)."""
