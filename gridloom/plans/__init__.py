"""The model facade and the catalogue of queries."""
