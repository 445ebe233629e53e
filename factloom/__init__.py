"""Facts about source code as DataFrames: sources, relational resolution, statistics."""
