"""marlspike: retrieval, ranking and corpus analytics over Spark DataFrames."""
