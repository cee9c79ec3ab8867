"""framelake: screen-state analytics on Spark DataFrames."""
