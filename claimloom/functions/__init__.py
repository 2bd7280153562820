"""Column functions: text, URLs, dates, identifiers."""
