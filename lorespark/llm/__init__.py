"""Training-data operators: one module per operator, all on DataFrames."""
