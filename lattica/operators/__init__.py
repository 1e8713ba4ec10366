"""Graph, table and retrieval operators over DataFrames."""
