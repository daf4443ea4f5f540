"""Column builders: observation states, identities, directions, tolerances, decisions, redaction."""
