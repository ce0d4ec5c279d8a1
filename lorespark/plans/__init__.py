"""Query text to DataFrame plans."""
