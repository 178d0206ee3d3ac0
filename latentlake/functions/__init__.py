"""Column expressions: identifiers, vectors and deterministic hash keys."""
