"""tidemark: agent-legibility analytics over captured web pages, on Spark DataFrames."""
