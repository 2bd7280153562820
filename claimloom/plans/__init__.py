"""SPARQL text to DataFrame plans."""
