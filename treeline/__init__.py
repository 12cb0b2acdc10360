"""treeline: versioned file-tree state as Spark DataFrames."""
