"""DataFrame operators: every function takes and returns DataFrames and works on all rows at once."""
