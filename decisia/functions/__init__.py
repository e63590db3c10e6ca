"""Column builders: hash-derived randomness, text canonicalisation, arithmetic on arrays."""
