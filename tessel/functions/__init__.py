"""See the README for the map of operators."""
