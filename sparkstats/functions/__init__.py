"""Column-level functions: derived columns, labels, predicates, distribution tails."""
