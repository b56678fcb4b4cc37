"""conegrid: category graphs, typed values and table operators as Spark DataFrames."""
