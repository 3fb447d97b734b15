"""Training-data operators: de-duplication, counting, search, scoring, mixing and output."""
