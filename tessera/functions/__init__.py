"""Column functions: text, vectors, dates, identifiers."""
