"""Operators over DataFrames: chunks, graph, search, ranking, centrality."""
