"""Column-expression helpers (casts, predicates, fixed vocabularies)."""
