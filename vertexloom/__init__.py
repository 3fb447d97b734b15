"""Property-graph queries over Spark tables, expressed as DataFrame plans."""
