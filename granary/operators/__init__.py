"""Table transforms: every function takes DataFrames and returns DataFrames."""
