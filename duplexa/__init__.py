"""Bipartite-graph analytics on Spark: projection, support, recommendation and evaluation as DataFrame plans."""
