"""relgraph: relevance retrieval over weighted relationship graphs, on Spark."""
