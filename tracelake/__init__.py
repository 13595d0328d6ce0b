"""tracelake: agent-trace analytics on Spark DataFrames."""
