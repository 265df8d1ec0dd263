"""Evidence-graph and link analytics on Spark."""
