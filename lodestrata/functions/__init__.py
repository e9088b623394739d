"""Column functions: text, predicates, dates, hashes and identifiers."""
