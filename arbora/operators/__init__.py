"""Graph operators on a PropertyGraph's DataFrames."""
