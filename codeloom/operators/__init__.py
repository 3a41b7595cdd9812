"""Graph operators over DataFrames."""
