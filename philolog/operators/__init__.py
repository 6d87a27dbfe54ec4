"""Query operators over the token table."""
