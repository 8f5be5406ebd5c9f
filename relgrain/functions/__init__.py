"""Column-level functions: periods, semantic types, instants."""
