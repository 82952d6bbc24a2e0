"""Query catalog: named jobs over the driver tables with their DuckDB oracles."""
