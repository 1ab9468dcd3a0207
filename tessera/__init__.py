"""tessera: corpus, retrieval and conversation analytics on Spark DataFrames."""
