"""Column-level building blocks: typed predicates, as-of selection, encodings."""
