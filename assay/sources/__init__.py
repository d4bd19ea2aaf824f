"""Sources: files to DataFrames."""
