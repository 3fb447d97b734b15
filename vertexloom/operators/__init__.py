"""What is computed: matches, responses and checks, as DataFrames."""
