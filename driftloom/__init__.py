"""driftloom: corpus-evolution analytics on Spark DataFrames."""
