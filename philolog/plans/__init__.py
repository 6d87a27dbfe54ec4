"""Query languages and their compiled form."""
